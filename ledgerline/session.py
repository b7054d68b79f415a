"""The session settings that all plans assume."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def builder(app: str = "ledgerline") -> SparkSession.Builder:
    """UTC time, adaptive plans with skew handling, Arrow for Python stages."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    out = SparkSession.builder.appName(app)
    for key, value in settings.items():
        out = out.config(key, value)
    return out


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local folder where it is unset and all runs on this machine, as in tests.

    On a cluster without the setting this raises: tables in a local folder would be spread over machines.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows from a table in the shared folder: computed once, and there if executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
