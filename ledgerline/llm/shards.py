"""Shards: rows with one key that one task handles whole, and how keys with too many rows are split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_hot(rows: DataFrame, key: str, spread: str, most: int) -> DataFrame:
    """The rows under keys that hold about ``2 * most`` rows at most; every pair of rows with one key still meets.

    A key with more than ``most`` rows is dealt into parts by the hash of ``spread``, and each pair of parts is a key of its own.
    Keys are longs. ``rows`` is read twice, so it should be a table.
    """
    hot = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > most).select(
        key, F.ceil(F.col("__n") / most).cast("int").alias("__parts")
    )
    part = F.pmod(F.xxhash64(F.lit(5), spread), F.col("__parts")).cast("int")
    other = F.explode(
        F.when(F.col("__parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("__parts") - 1))
    )
    dealt = rows.join(hot, key, "left").withColumn("__part", part).withColumn("__other", other)
    both = F.xxhash64(key, F.least("__part", "__other"), F.greatest("__part", "__other"))
    return dealt.withColumn(
        key, F.when(F.col("__parts").isNull(), F.col(key)).otherwise(both)
    ).drop("__parts", "__part", "__other")


def whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[int, int]], pa.Table]]:
    """Tables of whole shards, from batches sorted by the column ``shard``, and where the shards of two or more rows begin and end."""
    held: list[pa.RecordBatch] = []

    def cut() -> tuple[list[tuple[int, int]], pa.Table]:
        table = pa.Table.from_batches(held).combine_chunks()
        shard = table.column("shard").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
        return [(a, b) for a, b in zip(edges.tolist(), edges[1:].tolist()) if b - a > 1], table

    for batch in batches:
        if not batch.num_rows:
            continue
        shard = batch.column("shard").to_numpy()
        # the last shard of a batch may go on in the next one
        last = int(np.searchsorted(shard, shard[-1]))
        if held and (last or held[-1].column("shard")[-1].as_py() != shard[0]):
            if last:
                held.append(batch.slice(0, last))
            yield cut()
            held.clear()
        elif last:
            held.append(batch.slice(0, last))
            yield cut()
            held.clear()
        held.append(batch.slice(last))
    if held:
        yield cut()
