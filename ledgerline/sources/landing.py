"""Responses of a filings service as rows: a data source, and a load that lands what is missing.

Requests are dealt to tasks that share the allowed rate, retry as the service asks,
and hand their responses to Spark, which writes them through the cluster's file
system. A response lands under the digest of its URL: what is landed is not asked
for again, and of two loads that ask at once one row is read.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from . import commits
from .fetch import Fetcher, Pace, Transport, checked_url, landed_name

SCHEMA = "name string, url string, body binary, error string"
#: What the service allows a second, over all tasks.
PER_SECOND, TASKS, TRIES = 8.0, 4, 5


@dataclass(frozen=True)
class Rate:
    """How the tasks of one load share the service: each starts at most ``per_second / tasks`` requests a second."""

    per_second: float = PER_SECOND
    tasks: int = TASKS
    tries: int = TRIES

    def fetcher(self, transport: Transport, sleep: Callable[[float], None] = time.sleep) -> Fetcher:
        return Fetcher(transport, "", Pace(self.per_second / self.tasks, sleep=sleep), self.tries, sleep)


def _rows(urls: list[str], fetcher: Fetcher) -> Iterator[tuple[str, str, bytes | None, str | None]]:
    """A row for each URL; one that stays refused has its error, and the others go on."""
    for url in urls:
        try:
            yield landed_name(url), url, fetcher.fetched(url), None
        except (ConnectionError, ValueError) as e:
            yield landed_name(url), url, None, str(e)[:500]


def responses(urls: DataFrame, transport: Transport, rate: Rate = Rate(), url_col: str = "url") -> DataFrame:
    """Rows (name, url, body, error) of distinct URLs, dealt to the tasks that share the rate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetcher = rate.fetcher(transport)
        for batch in batches:
            for row in _rows(batch.column(0).to_pylist(), fetcher):
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.string(), pa.string(), pa.binary(), pa.string()))], ["name", "url", "body", "error"])

    wanted = urls.select(F.col(url_col).cast("string").alias("url")).where("url IS NOT NULL").distinct()
    return wanted.repartition(rate.tasks, "url").mapInArrow(run, SCHEMA)


def landed(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, url, body), one for each URL that was answered."""
    rows = commits.read(spark, path, SCHEMA).where("error IS NULL")
    return rows.groupBy("name").agg(F.first(F.struct("url", "body")).alias("r")).select("name", "r.url", "r.body")


def land(urls: DataFrame, path: str, transport: Transport, rate: Rate = Rate(), url_col: str = "url") -> DataFrame:
    """Fetches what is not landed and commits it; rows (url, error) of what could not be had."""
    spark = urls.sparkSession
    known = commits.read(spark, path, SCHEMA).where("error IS NULL").select("url")
    missing = urls.select(F.col(url_col).alias("url")).join(known, "url", "left_anti")
    if missing.isEmpty():
        return spark.createDataFrame([], "url string, error string")
    version = commits.append(spark, path, lambda folder: responses(missing, transport, rate).write.parquet(folder))
    new = commits.snapshot(spark, path, version).folders[-1]
    return spark.read.schema(SCHEMA).parquet(f"{path}/{new}").where("error IS NOT NULL").select("url", "error")


@dataclass
class _Part(InputPartition):
    urls: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        module, _, name = options["transport"].partition(":")
        self.module, self.name = module, name
        # each option's own line is one URL: a stated list
        self.urls = list(dict.fromkeys(u for u in options["urls"].split("\n") if u.strip()))
        self.rate = Rate(float(options.get("per_second", PER_SECOND)), int(options.get("tasks", TASKS)), int(options.get("tries", TRIES)))

    def partitions(self) -> list[InputPartition]:
        parts = [self.urls[k :: self.rate.tasks] for k in range(self.rate.tasks)]
        return [_Part(p) for p in parts if p] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        transport = getattr(importlib.import_module(self.module), self.name)
        yield from _rows(partition.urls, self.rate.fetcher(transport))


class Responses(DataSource):
    """``spark.read.format("filing_responses")`` with options urls (one a line), transport (module:function), per_second, tasks, tries."""

    @classmethod
    def name(cls) -> str:
        return "filing_responses"

    def schema(self) -> StructType | str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        for url in self.options["urls"].split("\n"):
            if url.strip():
                checked_url(url)
        return _Reader(self.options)
