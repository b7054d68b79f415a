"""A whole load from landed files to tables, again with news, and with a stage that fails."""

import json
from datetime import date

import pytest

from ledgerline.plans import ingestion
from ledgerline.sources import commits

ACC = "0000000001-24-{:06d}"


def payload(cik, *records):
    return cik, json.dumps({"cik": cik, "facts": {"us-gaap": {"Assets": {"units": {"USD": list(records)}}}}})


def record(n, value, filed, **more):
    return {"val": value, "accn": ACC.format(n), "fy": 2024, "fp": "FY", "end": "2024-09-28", "filed": filed, "form": "10-K"} | more


def submissions(cik, *rows):
    names = ("accessionNumber", "form", "filingDate", "reportDate", "primaryDocument")
    return cik, json.dumps({"filings": {"recent": {n: [r[i] for r in rows] for i, n in enumerate(names)}}})


def landed(spark, facts, filed, documents):
    return ingestion.Landed(
        spark.createDataFrame([(1, "AAPL", "Apple"), (2, "XOM", "Exxon")], "cik long, ticker string, name string"), spark.createDataFrame(facts, "cik long, json string"),
        spark.createDataFrame(filed, "cik long, json string"), spark.createDataFrame(documents, "accession_no string, html string"),
    )


def test_loads_follow_each_other(spark, tmp_path):
    root = str(tmp_path / "tables")
    page = "<p>Item 7. Management's Discussion and Analysis</p><p>Cash grew. Risks fell.</p>"
    filed = [submissions(1, (ACC.format(1), "10-K", "2024-11-01", "", "a.htm"), (ACC.format(2), "10-K/A", "2024-12-01", "", "b.htm"))]
    first = landed(spark, [payload(1, record(1, 5, "2024-11-01"), record(1, 6, "2024-11-01", end="bad"))], filed, [(ACC.format(1), page)])
    trace = ingestion.Load(spark, root, first).run()
    counts = {s.name: s.counts for s in trace.spans}
    assert counts["facts"] == {"facts_rows": 1, "refused_rows": 1} and counts["documents"]["filings_rows"] == 2 and counts["documents"]["chunks_rows"] == 1
    read = lambda name, kind: commits.read(spark, f"{root}/{name}", kind)
    assert [(r.cik, r.value) for r in read("facts", ingestion.CANDIDATE).collect()] == [(1, 5)]
    state = {(r.source, r.last_filing_date, r.last_accession) for r in read("ingestion_state", ingestion.CURSOR).collect()}
    assert state == {("facts", date(2024, 11, 1), ACC.format(1)), ("documents", date(2024, 11, 1), ACC.format(1))}
    assert spark.read.parquet(f"{root}/refused_facts").first().reason == "period_end"
    # the second document arrives with a restatement; the first filing is not read again
    second = landed(spark, [payload(1, record(1, 5, "2024-11-01"), record(2, 9, "2024-12-01"))], filed, [(ACC.format(1), "changed"), (ACC.format(2), page)])
    trace = ingestion.Load(spark, root, second).run()
    assert {s.name: s.counts for s in trace.spans}["documents"]["filings_rows"] == 1
    assert [(r.value, r.accession_no) for r in read("facts", ingestion.CANDIDATE).collect()] == [(9, ACC.format(2))]
    chunks = spark.read.parquet(f"{root}/chunks").collect()
    assert sorted({r.accession_no for r in chunks}) == [ACC.format(1), ACC.format(2)] and all("Cash grew" in r.text for r in chunks)
    # the page was embedded once
    assert commits.read(spark, f"{root}/embeddings", "digest string").count() == 1
    status = {r.status: (r.n, r.rows) for r in ingestion.Load(spark, root, second).statuses().collect()}
    assert status == {"OK": (1, 2), "SKIPPED": (1, 0)}


def test_a_stage_that_fails_leaves_the_others(spark, tmp_path):
    root = str(tmp_path / "tables")
    broken = landed(spark, [payload(1, record(1, 5, "2024-11-01"))], [(1, json.dumps({"filings": {"recent": {"accessionNumber": ["a"], "form": []}}}))], [("a", "x")])
    with pytest.raises(RuntimeError, match="documents") as failed:
        ingestion.Load(spark, root, broken).run()
    spans = {s.name: s for s in failed.value.trace.spans}
    assert spans["documents"].error and not spans["facts"].error and spans["facts"].counts["facts_rows"] == 1
    assert commits.snapshot(spark, f"{root}/facts").version == 1
