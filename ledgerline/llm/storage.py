"""Where operators put tables that cut lineage: the folder the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder

_made: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` from a table in the shared folder: computed once, safe if executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def forget(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        _delete(df.sparkSession, file.rsplit("/", 1)[0])


def tables_made() -> int:
    """How many tables there have been, for :func:`forget_since`."""
    return len(_made)


def forget_since(spark: SparkSession, mark: int) -> None:
    """Delete the tables made since then but for the last, which holds what came of them."""
    for path in _made[mark:-1]:
        _delete(spark, path)
    del _made[mark:-1]
