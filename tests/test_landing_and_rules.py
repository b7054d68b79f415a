import pytest

from ledgerline.operators import validation
from ledgerline.operators.facts import same_metadata, validated
from ledgerline.sources.fetch import Fetcher, Pace


def test_requests_are_paced():
    now, slept = [0.0], []
    pace = Pace(5, clock=lambda: now[0], sleep=slept.append)
    for _ in range(3):
        pace.wait()
    assert slept == pytest.approx([0.2, 0.4])
    with pytest.raises(ValueError):
        Pace(11)


def fetcher(answers, folder, slept):
    asked = []

    def transport(url):
        asked.append(url)
        answer = answers[len(asked) - 1]
        if isinstance(answer, Exception):
            raise answer
        return answer

    return Fetcher(transport, str(folder), Pace(10, sleep=lambda _: None), sleep=slept.append), asked


def test_retries_and_landing(tmp_path):
    slept = []
    f, asked = fetcher(
        [(429, {"Retry-After": "7"}, b""), (503, {}, b""), OSError("reset"), (200, {}, b"body")], tmp_path, slept
    )
    assert f.get("https://www.sec.gov/a", ".json") == b"body" and slept == [7.0, 2.0, 4.0]
    assert f.get("https://www.sec.gov/a", ".json") == b"body" and len(asked) == 4
    for url in ("http://www.sec.gov/a", "https://example.org/a"):
        with pytest.raises(ValueError):
            f.get(url)
    g, _ = fetcher([(404, {}, b"")], tmp_path, slept)
    with pytest.raises(ConnectionError, match="404"):
        g.get("https://www.sec.gov/b")


def test_chunk_rules_name_the_first_fault(spark):
    good = ("acc", 1, "A", "Notes", "t", 2024, "FY", "https://x", 0, 3, [0.1, 0.2])
    rows = [
        good, (*good[:10], [0.1]), (*good[:10], [0.1, float("nan")]), (*good[:4], " ", *good[5:]),
        (*good[:6], "Q9", *good[7:]), (*good[:10], None), (*good[:5], None, None, *good[7:])
    ]
    df = spark.createDataFrame(
        rows,
        "accession_no string, cik long, ticker string, section string, text string, fiscal_year int, fiscal_period string, source_url string, chunk_index int, token_count int, embedding array<float>"
    )
    kept, bad = validated(df, validation.chunk_rules(2))
    assert kept.count() == 2 and sorted(r.reject_reason for r in bad.collect()) == [
        "embedding", "embedding", "embedding", "fiscal_period", "text"
    ]


def test_feedback_and_metadata(spark):
    _, bad = validated(
        spark.createDataFrame([("t", 1), ("t", 0), ("", -1)], "trace_id string, rating int"),
        validation.feedback_rules()
    )
    assert sorted(r.reject_reason for r in bad.collect()) == ["rating", "trace_id"]
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2)], "accession_no string, cik int")
    assert [r[0] for r in same_metadata(rows, "accession_no", ["cik"]).collect()] == ["b"]


def test_landed_documents_are_decoded(spark, tmp_path):
    from ledgerline.sources.filings import documents

    (tmp_path / "a.htm").write_bytes("<p>é</p>".encode())
    (tmp_path / "b.htm").write_bytes("<p>é</p>".encode("latin-1"))
    assert sorted(r.html for r in documents(spark, str(tmp_path)).collect()) == ["<p>é</p>", "<p>\ufffd</p>"]
