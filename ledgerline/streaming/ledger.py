"""Facts as a stream of changes by key: what each company has filed, in whatever order it arrives.

The state is the log of changes itself, one table of commits, which is read by key; no
folder belongs to a company. A batch is joined with what earlier batches have left of
its keys: the last filing of each source, company, metric and period, and the cursor of
each source, company and metric, the greatest filing seen. A fact that is filed later
than the stored one is a change that replaces it, an older one that comes late changes
nothing. Of the log a batch reads the keys and filings alone; :func:`compact` keeps it
at one row for each fact and cursor. A batch that runs again sees the same earlier
batches and appends the same changes again, which reads as once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.facts import FACT_KEY, first_by
from ..sources import commits

STATE = ("source", "cik", "metric")
FILED = ("filing_date", "accession_no")


def changes(facts: DataFrame, log: DataFrame) -> DataFrame:
    """Rows (kind, replaces, columns of facts) that facts change in a log: facts that are filed last, and cursors that move.

    ``facts`` have at least the columns of FACT_KEY and source, filing_date, accession_no.
    """
    key, filed = ["source", *FACT_KEY], F.struct(*FILED)
    # of a batch the last filed counts, and of two rows of one filing the greater as text, in whatever order they come
    best = first_by(facts, key, *map(F.desc, FILED), F.to_json(F.struct(*facts.columns)).desc())

    def joined(rows: DataFrame, by: list[str], kind: str) -> DataFrame:
        old = log.where(F.col("kind") == kind).groupBy(*by).agg(F.max(filed).alias("__old"))
        old = old.withColumnsRenamed({c: f"__{c}" for c in by})
        # periods may be null, and null is one of them
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
        return rows.join(old, same, "left")

    new = joined(best, key, "fact").where(F.col("__old").isNull() | (filed >= F.col("__old")))
    moved = facts.groupBy(*STATE).agg(F.max(filed).alias("__new")).select(*STATE, "__new.*")
    cursors = joined(moved, list(STATE), "cursor").where(F.col("__old").isNull() | (filed > F.col("__old")))
    row = [F.col(c) if c in (*STATE, *FILED) else F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in facts.columns]
    return new.select(F.lit("fact").alias("kind"), F.col("__old.accession_no").alias("replaces"), *facts.columns).unionByName(
        cursors.select(F.lit("cursor").alias("kind"), F.lit(None).cast("string").alias("replaces"), *row)
    )


def follow(spark: SparkSession, incoming: str, schema: str, table: str, checkpoint: str, *, files: int | None = None) -> StreamingQuery:
    """Starts to append the changes of new fact files to a table of commits; stops when all that is there is read."""
    reader = spark.readStream.schema(schema)
    facts = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(incoming)

    def put(batch: DataFrame, number: int) -> None:
        before = _changes(batch.sparkSession, table, schema).where(F.col("batch") < number)
        rows = changes(batch, before).withColumn("batch", F.lit(number).cast("long"))
        commits.append(spark, table, lambda folder: rows.write.parquet(folder))

    return facts.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def _changes(spark: SparkSession, table: str, schema: str) -> DataFrame:
    return commits.read(spark, table, f"kind string, replaces string, {schema}, batch long")


def facts_now(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The last restatement of each fact."""
    rows = _changes(spark, table, schema).where("kind = 'fact'")
    last = first_by(rows, ["source", *FACT_KEY], F.desc("filing_date"), F.desc("accession_no"), F.desc("batch"))
    return last.drop("kind", "replaces", "batch")


def cursors_now(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """Rows (source, cik, last_filing_date, last_accession): the greatest filing of each company over all of its metrics."""
    rows = _changes(spark, table, schema).where("kind = 'cursor'")
    last = rows.groupBy("source", "cik").agg(F.max(F.struct("filing_date", "accession_no")).alias("m"))
    return last.select("source", "cik", F.col("m.filing_date").alias("last_filing_date"), F.col("m.accession_no").alias("last_accession"))


def compact(spark: SparkSession, table: str, schema: str) -> int:
    """Leaves one change for each fact and cursor; changes that are appended meanwhile are read and compacted too."""
    whole = f"kind string, replaces string, {schema}, batch long"

    def last(rows: DataFrame) -> DataFrame:
        order = (F.desc("filing_date"), F.desc("accession_no"), F.desc("batch"))
        known = first_by(rows.where("kind = 'fact'"), ["source", *FACT_KEY], *order)
        return known.unionByName(first_by(rows.where("kind = 'cursor'"), ["source", "cik", "metric"], *order))

    return commits.merge(spark, table, whole, last)
