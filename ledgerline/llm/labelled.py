"""Labelled rows for the classifiers: which may be learnt from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written


def held_out(id_col: str | Column) -> Column:
    """Whether a row is kept for testing: CRC-32 of its id as text is divisible by 5. A null id is not."""
    return F.coalesce(
        F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % 5 == 0,
        F.lit(False)
    )


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, *, id_col: str = "doc_id", text_col: str = "text", max_rows: int
) -> DataFrame:
    """Rows (text, label) of at most ``max_rows`` labelled documents that are not held out, chosen by a hash of the id.

    An id with several labels counts as the largest; null labels and ids are left out.
    """
    known = labels.where(
        F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col)
    ).groupBy(id_col).agg(F.max(label).cast("int").alias("__label"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    # at most max_rows ids: a fixed bound
    rows = docs.select(id_col, F.col(text_col).alias("text"))
    return written(rows.join(F.broadcast(chosen), id_col).select("text", F.col("__label").alias("label")), "training")
