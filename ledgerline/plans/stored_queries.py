"""Registered queries over what is at rest: indexes, caches, stage counts, loads."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import facts, lines, operations, repair, retrieval, text_index, vector_index
from ..session import shared_folder
from ..sources import cache, commits
from ..streaming import ledger
from . import tracing
from .domain import view
from .queries import A3, FACTS, LINES, STOP, VECTOR, _vectors, indexed_texts, latest, registered


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


PLACES = f"""slots AS (SELECT qid, slot, w[slot] AS term FROM (SELECT qid, w, unnest(generate_series(1, len(w))) AS slot FROM (SELECT qid, list_slice(regexp_extract_all(lower(query), '[a-z0-9]+'), 1, FIRST) AS w FROM questions) a) x WHERE w[slot] NOT IN ({STOP})),
wanted AS (SELECT DISTINCT qid, term FROM slots), sizes AS (SELECT qid, count(*) AS n FROM wanted GROUP BY qid),
places AS (SELECT id, place, w[place] AS term FROM (SELECT id, w, unnest(generate_series(1, len(w))) AS place FROM (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM chunks) c) x WHERE w[place] IN (SELECT term FROM wanted))"""


def _beginnings(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """The first n words of each question."""
    words = F.regexp_extract_all(F.lower("query"), F.lit("[a-z0-9]+"), F.lit(0))
    return view(spark, sf_dir, "questions").select("qid", F.array_join(F.slice(words, 1, n), " ").alias("query"))


@registered(
    PLACES.replace("FIRST", "5") + """, met AS (SELECT qid, id, p.term, place FROM places p JOIN wanted USING (term)),
full_ones AS (SELECT qid, id FROM met JOIN sizes USING (qid) GROUP BY qid, id, n HAVING count(DISTINCT term) = n),
whole AS (SELECT m.* FROM met m JOIN full_ones USING (qid, id)),
ends AS (SELECT e.qid, e.id, e.place AS stop, p.term, max(p.place) AS last FROM whole e JOIN whole p ON e.qid = p.qid AND e.id = p.id AND p.place <= e.place GROUP BY e.qid, e.id, e.place, p.term),
runs AS (SELECT qid, id, stop, min(last) AS start FROM ends JOIN sizes USING (qid) GROUP BY qid, id, stop, n HAVING count(*) = n),
covers AS (SELECT qid, id, start, min(stop) AS stop FROM runs GROUP BY qid, id, start),
dense AS (SELECT c.qid, c.id, c.start, 0.1::DOUBLE / (2 + (c.stop - c.start) - count(*)) AS d FROM covers c JOIN whole w ON w.qid = c.qid AND w.id = c.id AND w.place BETWEEN c.start AND c.stop GROUP BY c.qid, c.id, c.start, c.stop),
scored AS (SELECT qid, id, round(sum(d), 9) AS score FROM dense GROUP BY qid, id)
SELECT qid, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scored) x WHERE rank <= 10""",
    "chunks", "questions",
)
def text_cover_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with all of a question's first words, by cover density."""
    found = text_index.search(indexed_texts(spark, sf_dir), _beginnings(spark, sf_dir, 5), 10, mode="all")
    return found.select("qid", "id", F.round("text_score", 9).alias("score"))


@registered(
    PLACES.replace("FIRST", "3") + """, n_slots AS (SELECT qid, count(*) AS n FROM slots GROUP BY qid),
hits AS (SELECT qid, id, place - slot AS start FROM places JOIN slots USING (term) JOIN n_slots USING (qid) GROUP BY qid, id, place - slot, n HAVING count(DISTINCT slot) = n)
SELECT qid, id, round(count(*) * 0.1::DOUBLE, 9) AS score FROM hits GROUP BY qid, id""",
    "chunks", "questions",
)
def text_phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages where a question's first words follow one another."""
    chunks = view(spark, sf_dir, "chunks")
    found = text_index.search(indexed_texts(spark, sf_dir), _beginnings(spark, sf_dir, 3), max(1, chunks.count()), mode="phrase")
    return found.select("qid", "id", F.round("text_score", 9).alias("score"))


def _indexed_vectors(spark: SparkSession, sf_dir: str) -> tuple[vector_index.VectorIndex, DataFrame, DataFrame]:
    questions, rows = _vectors(spark, sf_dir)
    index = vector_index.VectorIndex(_folder(spark, "vector-index"))
    index.create(rows)
    return index, questions, rows


@registered(f"WITH {VECTOR} SELECT qid, id, CAST(rank AS INT) AS rank FROM vector_ranked WHERE rank <= 10")
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells are probed: the index prunes by its bounds alone and loses nothing."""
    index, questions, _ = _indexed_vectors(spark, sf_dir)
    return vector_index.search(index, questions, 10, probes=vector_index.EVERY).select("qid", "id", "rank")


@registered("SELECT count(*) AS questions, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the probes that the index takes by itself find nine of ten of the ten nearest vectors of all questions."""
    index, questions, rows = _indexed_vectors(spark, sf_dir)
    near = vector_index.search(index, questions, 10).select("qid", "id", F.lit(1).alias("found"))
    exact = retrieval.vector_search(questions, rows, 10).select("qid", "id")
    recall = F.count("found") >= 0.9 * F.count("*")
    return exact.join(near, ["qid", "id"], "left").agg(F.countDistinct("qid").alias("questions"), recall.alias("reached"))


@registered(
    "WITH firsts AS (SELECT count(DISTINCT text) AS n FROM documents WHERE doc_id % 2 = 0), every AS (SELECT count(DISTINCT text) AS n FROM documents) "
    "SELECT 1 AS run, n AS computed FROM firsts UNION ALL SELECT 2, every.n - firsts.n FROM every, firsts"
)
def cached_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts the model gets when half of the documents are embedded, then all, then all again, which computes and commits nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").select("doc_id", "text")
    path = _folder(spark, "embeddings")
    for rows in (docs.where("doc_id % 2 = 0"), docs, docs):
        cache.embedded(rows, path, 16)
    kind = "digest string, value array<float>, model string"
    parts = [
        commits.read(spark, path, kind, version=s.version).agg(F.count("*").alias("n")).withColumn("run", F.lit(s.version)) for s in commits.history(spark, path)
    ]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    before = F.coalesce(F.lag("n").over(facts.Window.orderBy("run")), F.lit(0))
    return total.select("run", (F.col("n") - before).alias("computed"))


@registered(
    "SELECT 'documents' AS stage, count(*) AS rows, sum(length(text)) AS chars FROM documents UNION ALL SELECT 'pages', count(*), sum(length(html)) FROM pages UNION ALL SELECT 'benchmark', count(*), sum(length(text)) FROM benchmark"
)
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and characters of three loads, counted by the writes themselves."""
    folder = _folder(spark, "loads")
    with tracing.trace("load") as load, tracing.span("load"):
        for name, column in (("documents", "text"), ("pages", "html"), ("benchmark", "text")):
            rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            with tracing.span(name):
                chars = F.sum(F.length(column))
                tracing.ran(rows, lambda df, n=name: df.write.parquet(f"{folder}/{n}"), chars=chars)
    seen = load.span_rows(spark).where("parent_id IS NOT NULL")
    return seen.select("stage", F.col("counts.rows").alias("rows"), F.col("counts.chars").alias("chars"))


@registered(
    "SELECT CAST(user_id AS VARCHAR) AS trace_id, event_type AS stage, CAST(sum(event_id % 1000) AS BIGINT) AS input_tokens, CAST(sum(event_id % 400) AS BIGINT) AS cached_tokens, CAST(sum(event_id % 200) AS BIGINT) AS output_tokens, "
    "round(CAST(sum(greatest(event_id % 1000 - event_id % 400, 0) * 2 + event_id % 400 * 0.5 + event_id % 200 * 8) * 0.000001 AS DOUBLE), 9) AS cost FROM events GROUP BY 1, 2"
)
def trace_stage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and cost of each stage of each request, each event being one call of a model."""
    prices = spark.createDataFrame([(0, "large", "model", "2", "0.5", "8")], tracing.PRICES)
    calls = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").cast("string").alias("trace_id"), F.col("event_type").alias("stage"), F.lit("large").alias("model"), F.lit("model").alias("kind"),
        *[(F.col("event_id") % n).alias(c) for c, n in (("input_tokens", 1000), ("cached_tokens", 400), ("output_tokens", 200))],
    )
    return operations.trace_totals(operations.call_cost(calls, prices)).withColumn("cost", F.round(F.col("cost").cast("double"), 9))


@registered(
    "SELECT CASE WHEN cik % 5 = 0 THEN 'SKIPPED' WHEN form_type = '10-K' THEN 'OK' ELSE 'FAILED' END AS status, count(*) AS n, CAST(sum(day(filing_date)) AS BIGINT) AS rows FROM filings GROUP BY 1",
    "filings"
)
def load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("cik") % 5 == 0, "SKIPPED").when(F.col("form_type") == "10-K", "OK").otherwise("FAILED")
    outcomes = view(spark, sf_dir, "filings").select(status.alias("status"), F.day("filing_date").alias("rows"))
    return operations.ingestion_summary(outcomes)


@registered(
    "named AS (SELECT *, concat(accession_no, '|', taxonomy_tag, '|', CAST(period_end AS STRING)) AS id FROM candidates) SELECT ticker, metric, fiscal_year, fiscal_period, unit, id FROM (SELECT *, row_number() OVER (PARTITION BY ticker, metric, fiscal_year, fiscal_period, unit ORDER BY filing_date DESC NULLS LAST, id DESC) AS rn FROM named) x WHERE rn = 1",
    "candidates",
)
def fact_latest_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = view(spark, sf_dir, "candidates").withColumn("id", F.concat_ws("|", "accession_no", "taxonomy_tag", F.col("period_end").cast("string")))
    return facts.latest_stored(named, "id").select("ticker", "metric", "fiscal_year", "fiscal_period", "unit", "id")


@registered(
    f"{A3} SELECT fiscal_year, fiscal_period, metric, ticker FROM latest ORDER BY fiscal_year, CASE fiscal_period WHEN 'FY' THEN 0 ELSE CAST(substr(fiscal_period, 2) AS INT) END, metric, ticker LIMIT 500",
    "candidates"
)
def fact_canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first facts in the order in which they are put out."""
    return facts.canonical_order(latest(spark, sf_dir)).select("fiscal_year", "fiscal_period", "metric", "ticker").limit(500)


IDENTITY = ["accession_no", "section", "chunk_index"]


@registered(
    "SELECT DISTINCT accession_no, section, chunk_index FROM chunks c WHERE id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM chunks s WHERE s.id % 3 = 0 AND s.accession_no = c.accession_no AND s.section = c.section AND s.chunk_index = c.chunk_index)",
    "chunks",
)
def new_chunk_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the passages of even ids those whose identity is not among the passages of ids divisible by three."""
    chunks = view(spark, sf_dir, "chunks")
    return facts.new_identities(chunks.where("id % 2 = 0"), chunks.where("id % 3 = 0"), IDENTITY).select(*IDENTITY)


@registered("SELECT accession_no FROM chunks GROUP BY accession_no HAVING count(DISTINCT section || '|' || fiscal_period) > 1", "chunks")
def disagreeing_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.same_metadata(view(spark, sf_dir, "chunks"), "accession_no", ["section", "fiscal_period"])


@registered(
    f"WITH {LINES} SELECT doc, n, regexp_matches(regexp_replace(line, '[\\s$€£¥%(),.\\-–—]', '', 'g'), '^\\d+$') AS numeric_cell, regexp_matches(line, '(?i)^(?:page\\s+)?(?:[A-Z]-)?\\d{{1,4}}$') AS page_number FROM lines WHERE regexp_matches(line, '\\d')"
)
def line_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines with digits are cells of numbers, or page numbers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = lines.lines_of(docs, "doc_id", "text").where(F.col("line").rlike(r"\d"))
    return rows.select("doc", "n", X.numeric_cell("line").alias("numeric_cell"), X.page_number("line").alias("page_number"))


def _scaled(value: str) -> str:
    cases = " ".join(f"WHEN abs({value}) >= {limit} THEN format('{{:,.2f}}', {value} / {limit}) || ' {letter}'" for limit, letter in ((1e12, "T"), (1e9, "Md"), (1e6, "M"), (1e3, "k")))
    return f"translate(CASE {cases} ELSE format('{{:,.2f}}', {value}) END, ',.', chr(160) || ',') || ' $'"


@registered(
    f"totals AS (SELECT ticker, metric, CAST(sum(value) AS DOUBLE) + 0.001 AS v FROM candidates GROUP BY 1, 2) SELECT ticker, metric, {_scaled('v')} AS shown FROM totals",
    "candidates"
)
def fact_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums as they are shown; a tenth of a cent keeps them off the halves, which engines round apart."""
    totals = view(spark, sf_dir, "candidates").groupBy("ticker", "metric").agg((F.sum("value").cast("double") + 0.001).alias("v"))
    return totals.select("ticker", "metric", X.money("v").alias("shown"))


@registered(
    "SELECT page_id AS doc, section, 0 AS size, reason FROM pages, (VALUES ('Risk Factors', 'the section is not in the document'), ('MD&A', 'the section is not in the document'), ('Notes', 'the notes title does not stand twice beside Item 8')) s(section, reason)"
)
def filing_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which expected sections the pages lack, read as annual reports; the SQL holds for pages without items, as those of the test tables."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("form_type", F.lit("10-K"))
    return repair.tagged_filings(pages, "page_id", "form_type", "html").where("kind = 'note'").select("doc", "section", "size", "reason")


FILED = "source string, cik long, metric string, fiscal_year int, fiscal_period string, taxonomy_tag string, filing_date date, accession_no string, value decimal(15,2)"


@registered(f"{A3} SELECT {', '.join(FACTS)} FROM latest", "candidates")
def streaming_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of a stream whose files hold filings out of order, each file a batch: what the batch load has."""
    incoming, table, state = (_folder(spark, n) for n in ("stream-in", "stream-table", "stream-state"))
    every = facts.primary_context(view(spark, sf_dir, "candidates")).withColumn("source", F.lit("facts"))
    columns = [F.col(c.split()[0]).cast(c.split()[1]) for c in FILED.split(", ")]
    every.select(*columns).repartition(3, F.xxhash64("accession_no")).write.parquet(incoming)
    ledger.follow(spark, incoming, FILED, table, state, files=1).awaitTermination()
    return ledger.facts_now(spark, table, FILED).select(*FACTS)
