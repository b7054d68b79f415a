"""Incremental and windowed jobs with Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.facts import FACT_KEY, first_by
from ..session import shared_folder
from ..sources import commits
from ..sources.tables import replace_partitions


def windowed_counts(
    events: DataFrame, time_col: str, key: str, length: str = "1 day", late: str = "10 days"
) -> DataFrame:
    """Counts per tumbling window and key; a timestamp without zone is taken as UTC, since watermarks need one."""
    timed = events.withColumn("__t", F.col(time_col).cast("timestamp")).withWatermark("__t", late)
    return timed.groupBy(F.window("__t", length), key).agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("time"), key, "n"
    )


def windowed_volume(spark: SparkSession, path: str) -> DataFrame:
    """All windows of one file as a stream that reads what is there and stops."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out")

    counts = windowed_counts(events, "ts", "event_type")
    counts.writeStream.outputMode("complete").option(
        "checkpointLocation", f"{root}/state"
    ).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select("time", "event_type", "n")


def ingest_facts(spark: SparkSession, incoming: str, schema: str, table: str, checkpoint: str) -> StreamingQuery:
    """Load new fact files into a table partitioned by company: late restatements replace, whatever order they come in.

    Each batch rewrites only the companies it touches and may be run again. For tables that need no folder for each company,
    and for state that outlives a batch, see :mod:`.ledger`.
    """

    def load(batch: DataFrame, number: int) -> None:
        keys = batch.select("cik").distinct()
        if commits.exists(spark, table):
            stored = spark.read.schema(batch.schema).parquet(table).join(keys, "cik", "left_semi")
        else:
            stored = spark.createDataFrame([], batch.schema)
        both = stored.withColumn("__new", F.lit(0)).unionByName(batch.withColumn("__new", F.lit(1)))
        merged = first_by(both, FACT_KEY, F.desc("filing_date"), F.desc("accession_no"), F.desc("__new")).drop("__new")
        # read before the partitions it comes from are replaced
        staged = f"{checkpoint}-staged-{number}"
        merged.write.mode("overwrite").parquet(staged)
        replace_partitions(spark.read.parquet(staged), table, "cik")

    stream = spark.readStream.schema(schema).parquet(incoming)
    return stream.writeStream.option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).foreachBatch(load).start()


def sessions(events: DataFrame, time_col: str, key: str, gap: str = "30 minutes") -> DataFrame:
    """Events of one key with no longer gap between them, an extension beyond time buckets."""
    return events.withColumn("__t", F.col(time_col).cast("timestamp")).groupBy(F.session_window("__t", gap), key).agg(F.count("*").alias("n")).select(
        key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n"
    )
