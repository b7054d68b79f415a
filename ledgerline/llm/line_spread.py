"""Line deduplication by distinct-site spread.

Every line's hash gets a HyperLogLog sketch of the sites it stands on, and one of
the texts; sketches merge by aggregation, before and after the shuffle, so a hot
line or a hot site sends one small sketch from each task. A line is widespread on
``min_sites`` sites if it also stands in as many different texts, as a text that
was copied to many sites takes all of its lines there. Lines whose estimate is
clearly past the threshold are taken; those near it, within four standard errors,
get an exact distinct count. A widespread line is boilerplate and goes from every
document.

Lightly changed copies are different texts. To keep their common lines, ask for
``min_neighbours``: then a line must also stand after, or before, so many
different lines (sketches and exact counts again), which the inner lines of a
copied text do not; nor do the inner lines of a block that is always printed
whole, which then stay.

Texts are cut into hashed lines once; sketches, counts and joins run on hashes.

Defined results: lines end at a line feed and are compared without leading and
trailing spaces; blank lines, and lines of fewer than ``min_words``
space-separated words, are never boilerplate; a null site is no site, but its
lines are removed all the same; a null text stays null; every row of the input
gives one row, also repeated rows and null ids; texts count whole at any length;
an empty table gives an empty result; the input may have columns of any name but
``__lines``, which is added.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written
from .text import pieces, texts_of

_HASH = xxhash.xxh64_intdigest


def _spread(lines: DataFrame, value: str, least: int, lg_k: int) -> DataFrame:
    """Rows (line_hash) of the lines with at least ``least`` distinct values: sketches first, exact counts near the threshold."""
    band = max(1, math.ceil(4 * 1.04 / math.sqrt(1 << lg_k) * least))
    known = lines.where(F.col(value).isNotNull())
    sketched = known.groupBy("line_hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg(value, lg_k)).alias("n"))
    spread = written(sketched.where(F.col("n") >= least - band), "spread")
    sure = spread.where(F.col("n") > least + band).select("line_hash")
    near = spread.where(F.col("n") <= least + band).select("line_hash")
    # values of near-threshold lines only: pairs are made distinct before they travel
    exact = known.join(
        near, "line_hash", "left_semi"
    ).groupBy("line_hash", value).agg(F.lit(1).alias("one")).groupBy("line_hash").agg(F.count(value).alias("n")).where(F.col("n") >= least)
    return sure.unionByName(exact.select("line_hash"))


SPREAD = 32  # so many tasks may share the copies of one text


def _bucket(docs: DataFrame, id_col: str) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(SPREAD)).cast("int") if id_col in docs.columns else F.lit(0)


def line_table(docs: DataFrame, *, site_col: str, text_col: str, id_col: str, min_words: int) -> DataFrame:
    """Rows (text_hash, text_bytes, bucket, site, line_hash, before, after), one for each line that counts.

    Hashes are those of the SQL function xxhash64 on trimmed lines; ``before`` and ``after`` are the neighbours'.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text"):
            rows, cols = [], ([], [], [], [], [])
            for i, text in enumerate(texts_of(batch.column("__text")).to_pylist()):
                if text is None:
                    continue
                bare = [x.strip(b" ") for x in text.split(b"\n")]
                hashes = [_HASH(x, 42) for x in bare]
                around = [None, *hashes, None]
                own = (_HASH(text, 42), len(text))
                for k, line in enumerate(bare):
                    if line and line.count(b" ") >= min_words - 1:
                        rows.append(i)
                        for c, v in zip(cols, (*own, hashes[k], around[k], around[k + 2])):
                            c.append(v)
            whole = [
                pa.array(np.array([v or 0 for v in c], np.uint64).view(np.int64), mask=np.array([v is None for v in c], bool)) for c in cols
            ]
            bucket, site = (batch.column(c).take(pa.array(rows, pa.int32())) for c in ("__bucket", "__site"))
            yield pa.RecordBatch.from_arrays(
                [*whole[:2], bucket, site, *whole[2:]],
                ["text_hash", "text_bytes", "bucket", "site", "line_hash", "before", "after"]
            )

    rows = docs.select(
        _bucket(docs, id_col).alias("__bucket"), F.col(site_col).cast("string").alias("__site"),
        F.col(text_col).alias("__text")
    )
    return rows.mapInArrow(
        run, "text_hash long, text_bytes long, bucket int, site string, line_hash long, before long, after long"
    )


def boilerplate_lines(lines: DataFrame, *, min_sites: int = 10, min_neighbours: int = 0, lg_k: int = 12) -> DataFrame:
    """Rows (line_hash) of the lines that stand on at least ``min_sites`` sites, in as many texts and beside ``min_neighbours`` different lines."""
    sites = written(_spread(lines.select("site", "line_hash"), "site", min_sites, lg_k), "sites")
    among = lines.join(sites, "line_hash", "left_semi").select(
        "line_hash", F.xxhash64("text_hash", "text_bytes").alias("of_text")
    )
    wide = written(_spread(among, "of_text", min_sites, lg_k), "wide")
    if not min_neighbours:
        return wide
    beside = written(
        lines.join(wide, "line_hash", "left_semi").select("line_hash", "before", "after").distinct(), "beside"
    )
    return _spread(beside, "before", min_neighbours, lg_k).unionByName(
        _spread(beside, "after", min_neighbours, lg_k)
    ).distinct()


def remove_boilerplate(
    docs: DataFrame, *, site_col: str = "source", text_col: str = "text", id_col: str = "doc_id", min_sites: int = 10,
    min_words: int = 1, min_neighbours: int = 0, lg_k: int = 12
) -> DataFrame:
    """The documents, all their columns, with boilerplate lines taken from the text, and the struct ``__lines`` (n, removed)."""
    lines = written(line_table(docs, site_col=site_col, text_col=text_col, id_col=id_col, min_words=min_words), "lines")
    common = written(
        boilerplate_lines(lines, min_sites=min_sites, min_neighbours=min_neighbours, lg_k=lg_k), "boilerplate"
    )
    # a text is keyed by its hash and length, so that rows need no key of their own; the bucket of its id spreads copies over tasks
    hits = lines.join(common, "line_hash", "left_semi").select(
        "text_hash", "text_bytes", "bucket", "line_hash"
    ).distinct()
    gone = hits.groupBy("text_hash", "text_bytes", "bucket").agg(F.collect_list("line_hash").alias("__gone")).withColumnsRenamed(
        {c: f"__{c}" for c in ("text_hash", "text_bytes", "bucket")}
    )
    text = F.col(text_col)
    joined = docs.join(
        gone,
        (F.xxhash64(text) == F.col("__text_hash")) & (F.octet_length(text).cast("long") == F.col("__text_bytes")) & (_bucket(docs, id_col) == F.col("__bucket")),
        "left"
    )
    every = F.split(text, "\n")
    counts = lambda x: (x != "") & (F.length(x) - F.length(F.replace(x, F.lit(" "))) >= min_words - 1)
    kept = F.filter(every, lambda x: ~(F.array_contains(F.col("__gone"), F.xxhash64(F.trim(x))) & counts(F.trim(x))))
    hit = F.col("__gone").isNotNull()
    n = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1)
    cleaned = F.when(hit, F.array_join(kept, "\n")).otherwise(text)
    tally = F.struct(
        n.cast("long").alias("n"), F.when(hit, F.size(every) - F.size(kept)).otherwise(0).cast("long").alias("removed")
    ).alias("__lines")
    return joined.select(*[cleaned.alias(c) if c == text_col else F.col(c) for c in docs.columns], tally)
