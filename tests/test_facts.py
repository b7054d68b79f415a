import json
from datetime import date

from pyspark.sql import functions as F

from ledgerline.operators import facts


def payload(units, cik=320193, taxonomy="us-gaap"):
    return json.dumps(
        {"cik": cik, "entityName": "Apple", "facts": {taxonomy: {tag: {"units": {"USD": records}} for tag, records in units.items()}}}
    )


def record(val, end, start=None, fy=2024, fp="FY", form="10-K", filed="2024-11-01", accn="0000320193-24-000123"):
    out = {"val": val, "accn": accn, "fy": fy, "fp": fp, "end": end, "filed": filed, "form": form}
    return out | ({"start": start} if start else {})


def run(spark, text, cik=320193):
    payloads = spark.createDataFrame([(cik, text)], "cik long, json string")
    companies = spark.createDataFrame([(cik, "AAPL", "Apple")], "cik long, ticker string, name string")
    return facts.fact_candidates(payloads, companies)


def test_preferred_tag_wins_and_unknown_tags_are_skipped(spark):
    good, bad = run(spark, payload({
        "Revenues": [record(99, "2024-09-28", "2023-10-01")],
        "RevenueFromContractWithCustomerExcludingAssessedTax": [record(100, "2024-09-28", "2023-10-01")],
        "Mystery": [record(1, "2024-09-28", "2023-10-01")],
    }, cik="320193"))
    rows = facts.primary_context(good).collect()
    assert [(r.value, r.taxonomy_tag) for r in rows] == [(100, "RevenueFromContractWithCustomerExcludingAssessedTax")]
    assert bad.count() == 0 and rows[0].source_url.endswith("/000032019324000123/0000320193-24-000123-index.html")


def test_quarter_takes_the_standalone_duration(spark):
    q = lambda v, s, e: record(v, e, s, 2025, "Q2", "10-Q", "2025-05-02", "0000320193-25-000057")
    good, _ = run(
        spark,
        payload({"Revenues": [q(90_753_000_000, "2023-12-31", "2024-03-30"), q(219_659_000_000, "2024-09-29", "2025-03-29"), q(95_359_000_000, "2024-12-29", "2025-03-29")]})
    )
    row = facts.primary_context(good).first()
    assert row.value == 95_359_000_000 and row.period_start == date(2024, 12, 29)


def test_year_takes_the_longest_duration(spark):
    good, _ = run(
        spark,
        payload({"NetIncomeLoss": [record(27, "2025-09-27", "2025-06-29", 2025), record(112_010_000_000, "2025-09-27", "2024-09-29", 2025)]})
    )
    assert facts.primary_context(good).first().value == 112_010_000_000


def test_last_restatement_wins(spark):
    good, _ = run(
        spark,
        payload({"NetIncomeLoss": [record(90_000_000_000, "2024-09-28", "2023-10-01"), record(91_000_000_000, "2024-09-28", "2023-10-01", form="10-K/A", filed="2024-11-15", accn="0000320193-24-000130")]})
    )
    row = facts.latest_restatement(facts.primary_context(good)).first()
    assert row.value == 91_000_000_000 and row.filing_date == date(2024, 11, 15) and row.form_type == "10-K"


def test_bad_records_are_rejected_with_a_reason(spark):
    _, bad = run(
        spark,
        payload({"Assets": [record(1, "2024-09-28", "2023-10-01"), record(1, "2024-13-28"), record(1, "2024-09-28", accn="x"), record(1, "2024-09-28", fy="zero"), record(1, "2024-09-28", filed="")], "Revenues": [record(1, "2024-09-28")]})
    )
    assert sorted(r.reject_reason for r in bad.collect()) == [
        "accession_no", "duration_without_start", "filing_date", "fiscal_year", "instant_with_start", "period_end"
    ]
    good, bad = run(spark, payload({"Assets": [record(1, "2024-09-28")]}, cik=7))
    assert good.count() == 0 and bad.first().reject_reason == "payload_of_another_company"


COLS = "cik long, ticker string, metric string, unit string, fiscal_year int, fiscal_period string, value double, taxonomy_tag string, filing_date date, accession_no string"


def fact(year, value, filed="2024-01-01", accn="a", tag="t", metric="revenue"):
    return (1, "AAPL", metric, "USD", year, "FY", value, tag, date.fromisoformat(filed), accn)


def test_gapped_years_and_zero_bases_have_no_change(spark):
    rows = spark.createDataFrame(
        [fact(2020, 100.0), fact(2022, 150.0), fact(2023, 120.0), fact(2023, 0.0, metric="net_income"), fact(2024, 5.0, metric="net_income")],
        COLS
    )
    got = facts.year_over_year(rows).collect()
    assert [(r.from_year, r.to_year, r.delta, r.percent_change) for r in got] == [(2022, 2023, -30.0, -20.0)]
    assert facts.year_over_year(rows, from_year=2023).count() == 0


def test_incremental_load_is_idempotent_and_skips_the_cursors_day(spark):
    stored = spark.createDataFrame([fact(2022, 1.0, "2023-02-01", "a1"), fact(2023, 2.0, "2024-02-01", "a2")], COLS)
    cursor = spark.createDataFrame(
        [(1, date(2024, 2, 1), "a2")], "cik long, last_filing_date date, last_accession string"
    )
    new = spark.createDataFrame([fact(2022, 1.5, "2024-03-01", "a3"), fact(2023, 9.0, "2024-02-01", "a9", "u")], COLS)
    once = facts.load_facts(stored, new, cursor.drop("last_accession"))
    assert sorted((r.fiscal_year, r.value) for r in once.collect()) == [(2022, 1.5), (2023, 2.0)]
    moved = facts.advance_cursor(cursor, once)
    assert tuple(moved.first()) == (1, date(2024, 3, 1), "a3")
    again = facts.load_facts(once, new, moved.drop("last_accession"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, once.collect()))
    assert tuple(facts.advance_cursor(moved, stored).first()) == (1, date(2024, 3, 1), "a3")


def test_context_is_the_most_frequent_period(spark):
    filings = spark.createDataFrame([("f1",), ("f2",)], "accession_no string")
    rows = spark.createDataFrame(
        [("f1", 2023, "FY"), ("f1", 2024, "FY"), ("f1", 2024, "Q1"), ("f1", 2023, "FY")],
        "accession_no string, fiscal_year int, fiscal_period string"
    )
    got = {r.accession_no: (r.fiscal_year, r.fiscal_period) for r in facts.fiscal_context(filings, rows).collect()}
    assert got == {"f1": (2023, "FY"), "f2": (None, None)}


def test_keep_latest_limits_groups_before_the_shuffle(spark):
    plan = facts.latest_restatement(spark.createDataFrame([fact(2022, 1.0)], COLS))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_rules_split_rows(spark):
    good, bad = facts.validated(spark.createDataFrame([(1,), (-1,), (None,)], "x int"), {"positive": F.col("x") > 0})
    assert good.count() == 1 and bad.count() == 2


def test_what_is_not_mapped_is_passed_over_in_any_shape(spark):
    facts_of = {"Assets": {"units": {"EUR": "none", "USD": [record(7, "2024-09-28")]}}, "Mystery": 5, "Liabilities": {"units": {}}}
    good, bad = run(spark, json.dumps({"cik": "320193", "facts": {"us-gaap": facts_of, "dei": {"Other": []}, "ifrs": None}}))
    assert [(r.metric, r.taxonomy_tag, r.tag_priority, r.unit, r.value) for r in good.collect()] == [("total_assets", "Assets", 0, "USD", 7)]
    assert bad.count() == 0


def test_days_that_are_none(spark):
    rows = [record(1, end) for end in ("2024-02-30", "0000-01-01", "2024-01-01\n", "2024-1-1", " 2024-01-01 ")]
    good, bad = run(spark, payload({"Assets": rows}))
    assert [r.period_end for r in good.collect()] == [date(2024, 1, 1)]
    assert [r.reject_reason for r in bad.collect()] == ["period_end"] * 4
