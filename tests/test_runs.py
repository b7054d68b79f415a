import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import evaluation
from ledgerline.plans import runs


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        (k, f"acc{k % 5}", ("MD&A", "Notes")[k % 2], k, f"T{k % 3}", f"Firm{k % 3} Inc", f"passage {k} names topic{k} besides matter{k} under heading{k} within region{k} together", 300 + k * 20) for k in range(30)
    ]
    df = spark.createDataFrame(
        rows,
        "id long, accession_no string, section string, chunk_index int, ticker string, name string, text string, token_count int"
    )
    return df.withColumn(
        "embedding", F.array(*[F.when(F.col("id") == i, 1.0).otherwise(0.01).cast("float") for i in range(30)])
    )


def test_ground_truth_is_balanced_and_explains_rejections(spark, chunks):
    ask = lambda texts: [(f"How would T0 T1 T2 weigh demand against supply risk {'today' if 'passage 7 ' in t else t.split()[1]} overall?", "passage 3 " not in t) for t in texts]
    good, why = runs.ground_truth(chunks, 6, ask, candidates=30)
    assert good.count() == 6 and good.select("ticker", "section").distinct().count() >= 4
    reasons = {r.reason: r.n for r in why.collect()}
    assert reasons["model_marked_generic"] == 1 and reasons["accepted"] >= 6
    same, _ = runs.ground_truth(
        chunks, 6, lambda texts: [("How would T0 T1 T2 weigh demand against supply risk overall?", True)] * len(texts),
        candidates=30
    )
    assert same.count() == 1


def test_pairs_must_match_the_corpus(spark, chunks):
    pairs = spark.createDataFrame(
        [(1, "acc1", "Notes", 1, "T1")], "qid int, accession_no string, section string, chunk_index int, ticker string"
    )
    assert [tuple(r) for r in runs.current_ids(pairs, chunks).collect()] == [(1, 1)]
    with pytest.raises(Exception, match="no such chunk"):
        runs.current_ids(pairs.withColumn("ticker", F.lit("X")), chunks).collect()


def test_comparison_of_approaches(spark, chunks):
    questions = chunks.where("id < 4").select(
        F.col("id").alias("qid"), F.concat(F.lit("topic"), "id").alias("query"), "embedding"
    )
    pairs = questions.select("qid", F.col("qid").alias("id"))
    mark = evaluation.corpus_fingerprint(chunks).first()[0]
    rows, told = runs.compare_retrieval(
        questions, chunks, pairs, cutoffs=(1, 5), primary=1, caps=(10,), expected_fingerprint=mark
    )
    got = {(r.approach, r.cutoff): r.mrr for r in rows.collect()}
    assert len(got) == 14 and all(v == 1.0 for v in got.values())
    assert told == {"best": "text_search", "production_confirmed": False}
    with pytest.raises(ValueError, match="corpus"):
        runs.compare_retrieval(questions, chunks, pairs, expected_fingerprint="other")


def test_numeric_run_and_persistence(spark, tmp_path):
    fact = ("revenue", 2024, "FY", 1.0, "USD")
    cases = [
        {"case_id": "a", "question": "x", "required": [fact], "allowed": [fact], "expect_refusal": False},
        {"case_id": "b", "question": "fail", "required": [fact], "allowed": [fact], "expect_refusal": False},
        {"case_id": "t", "question": "trap", "required": [], "allowed": [], "expect_refusal": True}
    ]
    answers = {"x": [fact], "trap": []}
    scores = runs.run_numeric(spark, cases, lambda q: answers[q])
    r = scores.first()
    assert (
        r.exact_match_rate, r.correct_refusal_rate, r.execution_error_rate, r.failed_case_ids
    ) == (0.5, 1.0, 0.333333, ["b"])
    one = runs.persist(scores, {"seed": 1}, "numeric", str(tmp_path / "runs")).first()[0]
    saved = spark.read.parquet(str(tmp_path / "runs")).first()
    assert saved.id == one and json.loads(saved.metrics)[0]["exact_match_rate"] == 0.5


def test_ingestion_of_facts_and_documents(spark):
    record = {
        "val": 5, "accn": "0000000001-24-000001", "fy": 2024, "fp": "FY", "end": "2024-09-28", "filed": "2024-11-01",
        "form": "10-K"
    }
    text = json.dumps(
        {"cik": 1, "facts": {"us-gaap": {"Assets": {"units": {"USD": [record, record | {"end": "bad"}]}}}}}
    )
    payloads = spark.createDataFrame([(1, text)], "cik long, json string")
    companies = spark.createDataFrame([(1, "AAPL", "Apple")], "cik long, ticker string, name string")
    from ledgerline.operators.facts import fact_candidates

    stored = fact_candidates(payloads, companies)[0].limit(0)
    cursor = spark.createDataFrame([], "cik long, last_filing_date date, last_accession string")
    after, moved, counts = runs.ingest_facts(payloads, companies, stored, cursor)
    assert after.count() == 1 and tuple(moved.first()) == (1, date(2024, 11, 1), record["accn"])
    assert {r.status: r.rows for r in counts.collect()} == {"OK": 1, "period_end": 1}
    found = spark.createDataFrame(
        [(record["accn"], 1, "10-K"), ("none", 1, "10-K")], "accession_no string, cik long, form_type string"
    )
    html = spark.createDataFrame(
        [(record["accn"], "<p>Item 7. Talk</p><p>one two. three</p>"), ("none", "")], "accession_no string, html string"
    )
    rows, notes = runs.ingest_documents(found, html, after, dimensions=8)
    assert [
        (r.section, r.text, r.fiscal_year, r.fiscal_period, len(r.embedding)) for r in rows.collect()
    ] == [("MD&A", "Talk\none two. three", 2024, "FY", 8)]
    assert [r.accession_no for r in notes.collect()] == ["none"]


def submission(cik, rows, files=()):
    names = ("accessionNumber", "form", "filingDate", "reportDate", "primaryDocument")
    arrays = {n: [r[i] for r in rows] for i, n in enumerate(names)}
    return json.dumps(
        {"filings": {"recent": arrays, "files": [{"name": n, "filingTo": d} for n, d in files]}}
    ), json.dumps(arrays)


def test_discovery_reads_history_files(spark):
    recent, _ = submission(
        1, [("a3", "10-K", "2024-03-01", "", "n3.htm"), ("a2", "10-Q", "2023-03-01", "", "n2.htm")],
        [("h1.json", "2022-12-31"), ("h0.json", "2010-12-31")]
    )
    _, older = submission(
        1,
        [("a2", "10-Q", "2023-03-01", "", "old2.htm"), ("a1", "10-K/A", "2022-03-01", "", "n1.htm"), ("a1", "10-K", "2022-03-01", "", "n1b.htm"), ("x", "8-K", "2022-05-01", "", "x.htm")]
    )
    payloads = spark.createDataFrame([(1, recent)], "cik long, json string")
    history = spark.createDataFrame([(1, "h1.json", older)], "cik long, name string, json string")
    cursor = spark.createDataFrame(
        [(1, date(2020, 1, 1), "z")], "cik long, last_filing_date date, last_accession string"
    )
    got = [(r.accession_no, r.primary_document) for r in runs.discover(payloads, cursor, history).collect()]
    assert got == [("a1", "n1b.htm"), ("a2", "old2.htm"), ("a3", "n3.htm")]  # the last met of each, oldest first
    with pytest.raises(Exception, match="not landed: h0.json"):
        runs.discover(payloads, cursor.limit(0), history).collect()


def test_stages_all_run_and_a_failure_shows_in_the_end():
    ran, spans = [], []
    with pytest.raises(RuntimeError, match="facts .*boom"):
        runs.run_stages(
            {"facts": lambda: (_ for _ in ()).throw(ValueError("boom")), "documents": lambda: ran.append(1)}, spans
        )
    assert ran == [1] and [
        (s.name, bool(s.error), s.seconds >= 0) for s in spans
    ] == [("facts", True, True), ("documents", False, True)]
    assert [s.name for s in runs.run_stages({"a": lambda: None})] == ["a"]


def test_numeric_gold_has_direct_comparison_and_trap_cases(spark):
    rows = [
        (f"T{t}", m, 2023 + y, "FY", float(100 * t + y), "USD") for t in range(3) for m in ("total_assets", "revenue") for y in range(2)
    ]
    facts = spark.createDataFrame(
        rows, "ticker string, metric string, fiscal_year int, fiscal_period string, value double, unit string"
    )
    from ledgerline.operators.facts import year_over_year

    got = evaluation.numeric_gold(facts, year_over_year(facts), direct=5, comparisons=2).collect()
    direct, pairs, traps = ([r for r in got if r.kind == k] for k in ("direct", "comparison", "no_answer"))
    assert [r.required[0].metric for r in direct] == [
        "revenue", "total_assets", "revenue", "total_assets", "revenue"
    ] and all(r.required[0].fiscal_year == 2024 for r in direct)
    assert len(pairs) == 2 and all(
        [f.fiscal_year for f in r.required] == [2023, 2024, 2024] and r.required[2].metric.endswith("_yoy_delta") and r.required[2].value == 1.0 for r in pairs
    )
    assert [r.case_id for r in traps] == list(evaluation.TRAPS) and all(
        r.expect_refusal and not r.required for r in traps
    )


def test_candidates_under_two_prompts(spark):
    questions = spark.createDataFrame([(1, "a?"), (2, "b?")], "qid int, question string").coalesce(1)
    write = lambda prompt, asked: [f"{prompt}{q}" for q in asked] if prompt != "bad" else 1 / 0
    got = {
        (r.prompt, r.qid): r.answer for r in evaluation.narrative_candidates(questions, {"production": "p", "citation_first": "bad"}, write).collect()
    }
    assert got == {
        ("production", 1): "pa?", ("production", 2): "pb?", ("citation_first", 1): None, ("citation_first", 2): None
    }


def test_fingerprint_is_one_digest_of_ordered_lines(spark, chunks):
    import hashlib

    rows = sorted(chunks.collect(), key=lambda r: (r.ticker, r.section, r.accession_no, r.chunk_index, r.id))
    want = hashlib.sha256(
        "".join(f"{r.accession_no}|{r.section}|{r.chunk_index}|{r.ticker}|{hashlib.sha256(r.text.encode()).hexdigest()}\n" for r in rows).encode()
    ).hexdigest()
    assert evaluation.corpus_fingerprint(chunks.repartition(5)).first()[0] == want
    assert evaluation.corpus_fingerprint(chunks.limit(0)).first()[0] == hashlib.sha256().hexdigest()
