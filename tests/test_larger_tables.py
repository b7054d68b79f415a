"""Queries against their SQL on tables with what only larger tables hold."""

import datetime
import decimal

import __spark_entry__ as entry


def plain(value):
    return round(float(value), 6) if isinstance(value, (float, decimal.Decimal)) else value


def same_as_sql(spark, folder, name, **tables):
    """The rows of a query over tables of these rows, which must be those of its SQL."""
    import duckdb

    con = duckdb.connect()
    for table, (kind, rows) in tables.items():
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = [tuple(map(plain, r)) for r in entry.queries()[name](spark, str(folder)).select(*names).collect()]
    assert sorted(got, key=repr) == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)
    return got


def test_references_that_are_cut_off(spark, tmp_path):
    html = ["<html><head><title>rates *** up &amp;&amp;&amp</title></head><body><p>b &lt c &lt; d &copy 2020 &copy; AT&T &</p></body></html>", "<p>&#39;x&amp;lt;</p>"]
    rows = [(k, f"http://a/{k}", h) for k, h in enumerate(html)]
    got = same_as_sql(spark, tmp_path, "html_sections", pages=("page_id long, url string, html string", rows))
    assert len(got) == 2


ORDERS = "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string"


def orders(*rows):
    return ORDERS, [(key, customer, datetime.datetime(1997, month, day), priority) for key, customer, month, day, priority in rows]


#: Keys from a million on are cut to six digits: filings of one year and company share an accession number, also on one day.
CUT = orders(
    (1234560, 8, 2, 1, "1-URGENT"), (1234561, 8, 3, 5, "3-MEDIUM"), (1234562, 8, 3, 5, "3-MEDIUM"), (1234563, 8, 3, 28, "3-MEDIUM"), (1234571, 8, 4, 6, "3-MEDIUM"),
    (1234572, 8, 6, 18, "2-HIGH"), (12345, 9, 2, 20, "3-MEDIUM"), (12, 9, 5, 11, "5-LOW"), (7654321, 11, 7, 9, "3-MEDIUM"), (7654322, 11, 8, 1, "3-MEDIUM"),
)


def test_filings_that_share_an_accession_number(spark, tmp_path):
    customers = [(k, f"Customer {k}") for k in (8, 9, 11)]
    got = same_as_sql(spark, tmp_path, "landed_filings", orders=CUT, customer=("c_custkey long, c_name string", customers))
    assert len({r[1] for r in got}) < len(set(got)) < len(got)


def test_outcomes_that_share_a_case(spark, tmp_path):
    got = same_as_sql(spark, tmp_path, "numeric_scoring", orders=CUT)
    assert got[0][0] > len(CUT[1])


def test_landed_facts_are_made_and_parsed_once(spark):
    found = entry.queries()["landed_fact_candidates"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1 and plan.count("from_json(") == 1


def test_facts_of_later_filings_ground_others(spark):
    from pyspark.sql import functions as F

    from ledgerline.operators import evaluation, facts

    rows = [(1, 5, "a"), (1, 7, "b"), (2, 5, "c"), (3, None, "d"), (3, None, "e"), (4, 8, "f"), (4, 7, "g"), (5, 9, "h"), (5, 2, "i")]
    primary = spark.createDataFrame(rows, "cik int, value int, accession_no string").selectExpr("*", "'revenue' AS metric", "2020 AS fiscal_year", "'FY' AS fiscal_period", "'USD' AS unit")
    got = evaluation.grounded_in_latest(primary, facts.FACT_KEY, F.asc("accession_no"))
    assert {(r.accession_no, r.supplied) for r in got.collect()} == {(a, a in "acfh") for _, _, a in rows if a not in "de"} | {("d", False), ("e", False)}
    later = evaluation.grounded_in_latest(primary, facts.FACT_KEY, F.desc("accession_no"))
    assert {r.accession_no for r in later.where("supplied").collect()} == {"b", "c", "g", "i", "a"}


LINES = (
    "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp",
    [(key, n, 3.0, float(10 * (key % 1000) + n), "NAR"[n % 3], datetime.datetime(1997, 9, n)) for key, *_ in CUT[1] for n in (1, 2, 3)],
)


def test_grounding_where_filings_share_an_accession_number(spark, tmp_path):
    got = same_as_sql(spark, tmp_path, "grounding_semi_anti", orders=CUT, lineitem=LINES)
    assert {r[-1] for r in got} == {True, False}
