"""A whole load of landed files into the tables at rest: facts, then documents, with what each stage read, kept and refused.

Each stage stands alone: one that fails is told and the others run. A stage writes
what it has made of its input once, counts it by that very write, and commits from
there, so another load that commits at the same time is merged with and nothing is
computed again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts, operations
from ..session import shared_folder
from ..sources import commits, filings, tables
from . import runs, tracing

CURSOR = "source string, cik bigint, last_filing_date date, last_accession string"
CANDIDATE = (
    "cik bigint, ticker string, company_name string, metric string, taxonomy_tag string, tag_priority int, unit string, fiscal_year int, fiscal_period string, "
    "period_start date, period_end date, value decimal(38,6), form_type string, filing_date date, accession_no string, source_url string"
)


@dataclass(frozen=True)
class Landed:
    """What was fetched: payloads (cik, json) of facts and of submissions, documents (accession_no, html), companies (cik, ticker, name)."""

    companies: DataFrame
    facts: DataFrame
    submissions: DataFrame
    documents: DataFrame


class Load:
    """One load into the tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str, landed: Landed):
        self.spark, self.root, self.landed = spark, root, landed
        self.staging = f"{shared_folder(spark)}/load-{uuid.uuid4().hex}"

    def _staged(self, rows: DataFrame, name: str) -> DataFrame:
        path = f"{self.staging}/{name}"
        tracing.ran(rows, lambda df: df.write.parquet(path), f"{name}_")
        return self.spark.read.schema(rows.schema).parquet(path)

    def cursor(self, source: str) -> DataFrame:
        rows = commits.read(self.spark, f"{self.root}/ingestion_state", CURSOR)
        return rows.where(F.col("source") == source).drop("source")

    def _advance(self, source: str, loaded: DataFrame) -> None:
        """Moves the cursors of a source forward, whatever another load has made of them meanwhile."""

        def moved(rows: DataFrame) -> DataFrame:
            mine = facts.advance_cursor(rows.where(F.col("source") == source).drop("source"), loaded)
            return rows.where(F.col("source") != source).unionByName(mine.withColumn("source", F.lit(source)))

        commits.merge(self.spark, f"{self.root}/ingestion_state", CURSOR, moved)

    def load_facts(self) -> None:
        good, bad = facts.fact_candidates(self.landed.facts, self.landed.companies)
        fresh = self._staged(facts.latest_facts(good), "facts")
        refused = self._staged(bad.select("cik", "accession_no", "taxonomy_tag", F.col("reject_reason").alias("reason")), "refused")
        tables.append(refused, f"{self.root}/refused_facts")
        cursor = self.cursor("facts").select("cik", "last_filing_date")
        known = CANDIDATE
        commits.merge(self.spark, f"{self.root}/facts", known, lambda stored: facts.load_facts(stored, fresh.select(*stored.columns), cursor))
        self._advance("facts", fresh)

    def load_documents(self) -> None:
        found = self._staged(filings.new_filings(filings.submission_filings(self.landed.submissions), self.cursor("documents")), "filings")
        known = commits.read(self.spark, f"{self.root}/facts", CANDIDATE)
        # a filing whose document is not landed stays new
        have = found.join(self.landed.documents.select("accession_no").distinct(), "accession_no", "left_semi")
        rows, notes = runs.ingest_documents(have, self.landed.documents, known, embeddings_at=f"{self.root}/embeddings")
        chunks = self._staged(rows, "chunks")
        self._staged(notes, "notes")
        tables.replace_partitions(chunks, f"{self.root}/chunks", "accession_no")
        tables.upsert_table(have, f"{self.root}/filings", ["accession_no"], F.desc("filing_date"))
        self._advance("documents", have)

    def statuses(self) -> DataFrame:
        """Rows (status, n, rows): companies with and without an annual report, and their filings."""
        every = filings.submission_filings(self.landed.submissions).groupBy("cik").agg(F.collect_list("form_type").alias("forms"))
        listed = self.landed.companies.select("cik").join(every, "cik", "left").withColumn("forms", F.coalesce("forms", F.array().cast("array<string>")))
        found = filings.discovery_status(listed).join(listed.select("cik", F.size("forms").alias("rows")), "cik")
        return operations.ingestion_summary(found)

    def run(self) -> tracing.Trace:
        """All stages, each a span with its counts; raises in the end if any failed, with the trace as ``trace``."""
        with tracing.trace("load") as state, commits.discarded(self.spark, self.staging):
            try:
                runs.run_stages({"facts": self.load_facts, "documents": self.load_documents})
            except RuntimeError as e:
                e.trace = state  # type: ignore[attr-defined]
                raise
        return state
