"""Tables at rest: read with a schema, replaced by partition, appended, upserted by commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.facts import upsert
from . import commits

SCHEMAS = {
    "companies": "cik bigint, ticker string, name string, sic string, updated_at timestamp",
    "filings": "accession_no string, cik bigint, form_type string, filing_date date, period_of_report date, primary_doc_url string",
    "financial_facts": "id bigint, cik bigint, ticker string, metric string, taxonomy_tag string, unit string, fiscal_year int, fiscal_period string, period_start date, period_end date, value decimal(38,6), form_type string, filing_date date, accession_no string, source_url string",
    "doc_chunks": "id bigint, accession_no string, cik bigint, ticker string, fiscal_year int, fiscal_period string, section string, chunk_index int, text string, token_count int, source_url string, embedding array<float>, terms array<string>",
    "ingestion_state": "source string, cik bigint, last_filing_date date, last_accession string, updated_at timestamp",
    "query_logs": "trace_id string, session_id string, question string, intent string, route string, latency_ms int, input_tokens bigint, output_tokens bigint, cached_tokens bigint, cost_usd decimal(38,12), grounded boolean, created_at timestamp",
    "feedback": "trace_id string, rating smallint, comment string, created_at timestamp",
    "eval_runs": "id string, kind string, config string, metrics string, created_at timestamp",
}
#: what read-only sessions see
READ_ONLY = ("companies", "filings", "financial_facts", "doc_chunks", "ingestion_state")


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def read_only_session(spark: SparkSession, root: str, names: tuple[str, ...] = READ_ONLY) -> SparkSession:
    """A session of its own whose only views are the named tables."""
    own = spark.newSession()
    for name in names:
        own.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}").createOrReplaceTempView(name)
    return own


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Replace the whole of each partition that ``df`` has rows of; others stay."""
    df.repartition(*keys).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*keys).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_runs(runs: DataFrame, path: str) -> DataFrame:
    """Append evaluation runs in one write; the id is a hash of their content."""
    keyed = runs.withColumn(
        "id", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in sorted(runs.columns)]), 256)
    )
    append(keyed, path)
    return keyed.select("id")


def upsert_table(incoming: DataFrame, path: str, key: list[str], *order: Column) -> int:
    """Upsert by key into a table of commits, read by :func:`read_versioned`; returns the version.

    Of the incoming rows the first of each key wins. If another writer commits meanwhile, its rows are merged with.
    """
    return commits.merge(incoming.sparkSession, path, incoming.schema, lambda stored: upsert(stored, incoming, key, *order))


def read_versioned(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The last committed version of a table; no rows if there is none."""
    return commits.read(spark, path, schema)


def upsert_filings(incoming: DataFrame, path: str) -> int:
    """Filings by accession: the last filed, then the larger address, of those that come in replaces what is stored."""
    return upsert_table(
        incoming, path, ["accession_no"], F.col("filing_date").desc_nulls_last(),
        F.col("primary_doc_url").desc_nulls_last()
    )


def write_dataset(rows: DataFrame, path: str) -> int:
    """A JSON dataset, complete or not there; returns the version."""
    return commits.replace(rows.sparkSession, path, lambda folder: rows.write.json(folder))


def healthy(spark: SparkSession) -> bool:
    return spark.sql("SELECT 1").first()[0] == 1
