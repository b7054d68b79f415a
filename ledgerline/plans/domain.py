"""The filings domain as views over the driver's tables: one SQL text for every engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COMPANIES = "SELECT c_custkey + 1 AS cik, concat('T', CAST(c_custkey AS STRING)) AS ticker, c_name AS name FROM {customer}"

FILINGS = """
SELECT concat(lpad(CAST(o_custkey + 1 AS STRING), 10, '0'), '-', substr(CAST(year(o_orderdate) AS STRING), 3, 2), '-', lpad(CAST(o_orderkey AS STRING), 6, '0')) AS accession_no,
       o_custkey + 1 AS cik, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '10-K' ELSE '10-Q' END AS form_type, CAST(o_orderdate AS DATE) AS filing_date
FROM {orders}
"""

CANDIDATES = """
SELECT o_custkey + 1 AS cik, concat('T', CAST(o_custkey AS STRING)) AS ticker,
       CASE l_linenumber % 5 WHEN 1 THEN 'revenue' WHEN 2 THEN 'net_income' WHEN 3 THEN 'total_assets' WHEN 4 THEN 'total_liabilities' ELSE 'cash_and_equivalents' END AS metric,
       concat('Tag', l_returnflag) AS taxonomy_tag, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS tag_priority, 'USD' AS unit,
       CAST(year(o_orderdate) AS INT) AS fiscal_year,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'FY' ELSE concat('Q', CAST(quarter(o_orderdate) AS STRING)) END AS fiscal_period,
       CASE WHEN l_linenumber % 5 IN (1, 2) THEN CAST(l_shipdate AS DATE) - CAST(l_quantity AS INT) END AS period_start,
       CAST(l_shipdate AS DATE) AS period_end, l_extendedprice AS value,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '10-K' ELSE '10-Q' END AS form_type, CAST(o_orderdate AS DATE) AS filing_date,
       concat(lpad(CAST(o_custkey + 1 AS STRING), 10, '0'), '-', substr(CAST(year(o_orderdate) AS STRING), 3, 2), '-', lpad(CAST(o_orderkey AS STRING), 6, '0')) AS accession_no
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

CHUNKS = """
SELECT doc_id AS id, concat('ACC-', CAST(doc_id % 997 AS STRING)) AS accession_no, doc_id % 150 + 1 AS cik, concat('T', CAST(doc_id % 150 AS STRING)) AS ticker,
       CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(2015 + doc_id % 8 AS INT) END AS fiscal_year, CASE doc_id % 5 WHEN 0 THEN 'FY' ELSE concat('Q', CAST(doc_id % 5 AS STRING)) END AS fiscal_period,
       CASE doc_id % 3 WHEN 0 THEN 'MD&A' WHEN 1 THEN 'Risk Factors' ELSE 'Notes' END AS section, CAST(doc_id AS INT) AS chunk_index, text, concat('https://www.sec.gov/', source) AS source_url
FROM {documents}
"""

QUESTIONS = "SELECT item_id AS qid, text AS query FROM {benchmark}"

LOGS = """
SELECT CAST(ts AS TIMESTAMP) AS created_at, CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 17 = 0 THEN NULL ELSE event_type END AS intent,
       CASE WHEN event_id % 19 = 0 THEN NULL ELSE value END AS latency_ms, CAST(user_id AS STRING) AS session_id,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 3 <> 0 END AS grounded,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 100 AS DOUBLE) / 64 END AS cost_usd, event_id
FROM {events}
"""

FEEDBACK = "SELECT doc_id AS trace_id, CASE WHEN quality = 1 THEN 1 ELSE -1 END AS rating FROM {labels}"

VIEWS = {
    "companies": COMPANIES, "filings": FILINGS, "candidates": CANDIDATES, "chunks": CHUNKS, "questions": QUESTIONS,
    "query_logs": LOGS, "feedback": FEEDBACK
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    tables = {
        t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders", "lineitem", "documents", "benchmark", "events", "labels") if "{" + t + "}" in text
    }
    return spark.sql(text, **tables)


def with_views(sql: str, *names: str) -> str:
    """The same views as common table expressions before a query."""
    plain = {n: VIEWS[n].replace("{", "").replace("}", "") for n in names}
    return "WITH " + ", ".join(f"{n} AS ({q})" for n, q in plain.items()) + (
        ", " if not sql.lstrip().upper().startswith("SELECT") else " "
    ) + sql
