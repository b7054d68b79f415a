"""Benchmark decontamination by winnowing.

The smallest hash of the ``gram``-word shingles of ``window`` consecutive words
is the window's fingerprint, so a shared run of ``window`` words has the same
fingerprint on both sides. Documents' fingerprints are joined to those of the
benchmark, and a hit is extended to the windows around it: each is compared as a
whole (by a 64-bit hash). Items shorter than a window are their own fingerprint.

Most fingerprints of a corpus are in no benchmark, so documents drop those whose
bit is not set in a bitmap of the benchmark's, of a fixed ``2**BITS`` bits at any
size of either; what it lets through by chance fails in the join. The corpus is
read once. Rows of the join are salted by the text, as one passage may stand in
very many documents, and equal texts are reduced to one before it.

Defined results: null or wordless texts have no hits; null item ids are left
out; an item id that occurs in several rows is one item with the windows of all
its rows; every row of the documents gives one row, also repeated ones and null
ids. Texts count whole at any length; without items nothing is hit; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import written
from .text import Rolling, WordHashes, concat, freeing, pieces, texts_of

# bytes outside of words become spaces, A-Z become a-z
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_hashes = WordHashes(seed=10)
BITS = 26  # a bitmap of 8 MB
SALTS = 16


def _forget_words() -> None:
    _hashes.clear()


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


def smallest(grams: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive hashes."""
    low, have = grams, 1
    while have < width:
        step = min(have, width - have)
        low, have = np.minimum(low[: len(low) - step], low[step:]), have + step
    return low


def item_windows(text: bytes | None, window: int, gram: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Size of an item's windows, their hashes and their fingerprints; a window that repeats stands once."""
    rolling = Rolling(_hashes.of(found := words(text)))
    size = min(window, len(found))
    if not size:
        return 0, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    whole, at = np.unique(rolling.grams(size), return_index=True)
    return size, whole, smallest(rolling.grams(gram), window - gram + 1)[at] if size == window else whole


@dataclass
class Marks:
    """Which sizes of windows there are, and one bit for each fingerprint and each window of the benchmark."""

    sizes: list[int]
    prints: np.ndarray
    windows: np.ndarray

    @staticmethod
    def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(65 - (64 * len(bits)).bit_length())
        return bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) == 1


def candidates(texts: list[bytes | None], marks: Marks, window: int, gram: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The number of words of each text, and the windows that may be in the benchmark: (text, start, size, fingerprint, hash)."""
    flat, begins = concat(map(words, texts))
    rolling = Rolling(_hashes.of(flat))
    found = []
    for size in marks.sizes:
        whole = rolling.grams(size)
        if size < window:
            at, prints = np.flatnonzero(marks.may_hold(marks.windows, whole)), whole
        else:
            prints = smallest(rolling.grams(gram), window - gram + 1)
            # neighbouring windows mostly have one fingerprint: look each run up once
            first = np.flatnonzero(
                np.concatenate([[True], prints[1:] != prints[:-1]])
            ) if len(prints) else np.zeros(0, np.int64)
            held = marks.may_hold(marks.prints, prints[first])
            at = np.flatnonzero(
                np.repeat(held, np.diff(np.append(first, len(prints))))
            ) if held.any() else np.zeros(0, np.int64)
            at = at[marks.may_hold(marks.windows, whole[at])]
        owner = np.searchsorted(begins, at, "right") - 1
        keep = at + size <= begins[owner + 1]
        at, owner = at[keep], owner[keep]
        found.append([owner, at - begins[owner], np.full(len(at), size), prints[at], whole[at]])
    return np.diff(begins), [
        np.concatenate(c) for c in zip(*found)
    ] if found else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    """Rows (item, size, print, window): the windows of the benchmark and their fingerprints."""

    @freeing(_forget_words)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            for i, text in enumerate(texts_of(batch.column("text")).to_pylist()):
                size, whole, prints = item_windows(text, window, gram)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item").take(pa.array([i] * len(whole), pa.int32())), pa.array([size] * len(whole), pa.int32()), pa.array(prints.view(np.int64)), pa.array(whole.view(np.int64))],
                    ["item", "size", "print", "window"]
                )

    rows = benchmark.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")
    )
    return written(
        rows.mapInArrow(run, "item string, size int, print long, window long").distinct(), "benchmark-windows"
    )


def marks_of(prints: DataFrame) -> Marks:
    """The bitmaps, made by aggregation: at most ``2**BITS / 64`` numbers each reach the driver."""

    def bits(column: str) -> np.ndarray:
        at = F.shiftrightunsigned(column, 64 - BITS).alias("at")
        rows = prints.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")
        ).toArrow()
        out = np.zeros(1 << BITS - 6, np.int64)
        out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
        return out.view(np.uint64)

    return Marks(sorted(r.size for r in prints.select("size").distinct().collect()), bits("print"), bits("window"))


def _scanned(
    docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int,
    gram: int
) -> tuple[DataFrame, DataFrame]:
    """(rows (id, text_hash, text_bytes, n_words) of all documents, rows (text_hash, text_bytes, start, size, item) of their hits)."""
    prints = benchmark_windows(benchmark, item_col, item_text_col, window, gram)
    shared = docs.sparkSession.sparkContext.broadcast(marks_of(prints))
    kind = docs.schema[id_col].dataType

    @freeing(_forget_words)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["__id", "text_hash", "text_bytes", "n_words", "start", "size", "print", "window"]
        for batch in pieces(batches, "__text"):
            texts = texts_of(batch.column("__text")).to_pylist()
            n_words, (owner, start, size, low, whole) = candidates(texts, shared.value, window, gram)
            own = [(None, None) if t is None else (xxhash.xxh64_intdigest(t, 42), len(t)) for t in texts]
            key = pa.array([None if h is None else h - (h >> 63 << 64) for h, _ in own], pa.int64())
            length = pa.array([n for _, n in own], pa.int64())
            none = [pa.nulls(len(texts), k) for k in (pa.int64(), pa.int32(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), key, length, pa.array(n_words), *none], names)
            if len(owner):
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(owner), batch.schema.field("__id").type), key.take(at), length.take(at), pa.nulls(len(owner), pa.int64()), pa.array(start), pa.array(size.astype(np.int32)), pa.array(low.view(np.int64)), pa.array(whole.view(np.int64))],
                    names
                )

    fields = [
        T.StructField("__id", kind),
        *(T.StructField(n, T.IntegerType() if n == "size" else T.LongType()) for n in ("text_hash", "text_bytes", "n_words", "start", "size", "print", "window"))
    ]
    scanned = written(
        docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, T.StructType(fields)),
        "scanned"
    )
    rows = scanned.where("n_words IS NOT NULL").select("__id", "text_hash", "text_bytes", "n_words")
    hits = scanned.where("n_words IS NULL").select(
        "text_hash", "text_bytes", "start", "size", "print", "window"
    ).distinct()
    salted = hits.withColumn("salt", F.pmod("text_hash", F.lit(SALTS)).cast("int"))
    spread = prints.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # the fingerprints meet, and the windows around them are equal as a whole
    return rows, salted.join(spread, ["salt", "print", "size", "window"]).select(
        "text_hash", "text_bytes", "start", "size", "item"
    )


def _spans(starts: np.ndarray, sizes: np.ndarray) -> list[dict[str, int]]:
    order = np.argsort(starts, kind="stable")
    begin, end = starts[order], np.maximum.accumulate((starts + sizes)[order])
    new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
    return [{"start": a, "end": b} for a, b in zip(begin[new].tolist(), end[np.append(new[1:], len(end)) - 1].tolist())]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = 10, gram: int = 5
) -> DataFrame:
    """One row per document: its id, ``n_words``, hit ``spans`` (word offsets, end exclusive) and ``items`` found."""
    rows, hits = _scanned(docs, benchmark, id_col, text_col, item_col, item_text_col, window, gram)
    found = hits.groupBy("text_hash", "text_bytes").agg(
        F.collect_set(F.struct("start", "size")).alias("windows"), F.collect_set("item").alias("items")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            flat, ends = batch.column("windows").flatten(), np.cumsum([0, *(len(x) for x in batch.column("windows"))])
            start, size = (flat.field(k).to_numpy() for k in (0, 1))
            spans = [_spans(start[a:b], size[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_hash"), batch.column("text_bytes"), pa.array(spans, kind), batch.column("items")],
                ["text_hash", "text_bytes", "spans", "items"]
            )

    made = found.mapInArrow(
        run,
        T.StructType([found.schema["text_hash"], found.schema["text_bytes"], T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
    )
    out = rows.join(made, ["text_hash", "text_bytes"], "left")
    return out.select(
        F.col("__id").alias(id_col), "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = 10, gram: int = 5
) -> DataFrame:
    """The documents, all their columns, without those that share a window with the benchmark."""
    _, hits = _scanned(
        docs.select(F.lit(0).alias("__none"), F.col(text_col).alias("__own")), benchmark, "__none", "__own", item_col,
        item_text_col, window, gram
    )
    gone = hits.select(F.col("text_hash").alias("__hash"), F.col("text_bytes").alias("__bytes")).distinct()
    return docs.join(
        gone, (F.xxhash64(text_col) == F.col("__hash")) & (F.octet_length(text_col) == F.col("__bytes")), "left_anti"
    )
