"""Substring deduplication by relative Lempel-Ziv parsing.

A document is parsed greedily against the texts of all smaller ids: at each word
the longest factor of at least ``window`` words, every window of which stands in
a smaller id, or else one literal word; then on from its end. Windows that lie
across the end of a factor are checked too, and factors and such windows are the
duplicate spans. The reference of the parse is all smaller documents at once:
one after another would be a join of every document with every block of the
reference.

So the index is cut by content into blocks: each window is anchored at the
smallest hash of its ``gram``-word shingles, so equal windows have equal anchors,
and neighbouring windows with one anchor form a segment, aligned at the anchor in
one block.

* A segment that equals one of a smaller id lies inside of a factor as a whole.
* Where a factor begins or ends, segments only overlap in part. There the block
  compares its segments window by window, and each first segment gets a mask of
  its windows that also start in a smaller id.

Equal segments are reduced before they travel and again on arrival (smallest id).
A passage that is shorter than a window, but longer than a shingle, may anchor
different segments of very many documents. A block that holds more than
``BLOCK_SEGMENTS`` by an estimate from one in ``SKETCH`` of the texts is dealt
segment by segment, and its windows are compared by a join on their hashes: how
a block is dealt changes no result.

Defined results: words are runs of bytes other than ASCII white space; a null
text has none; rows with a null id keep all words and are no reference; rows
with one id are one document to the others and never duplicates of each other.
Ids are whole numbers. Texts count whole at any length; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import written
from .text import Rolling, WordHashes, concat, freeing, pieces, texts_of

_hashes = WordHashes(seed=3)


def _forget_words() -> None:
    _hashes.clear()

BLOCK_SEGMENTS, SKETCH = 20_000, 64
PARTITION_BYTES = 16 << 20
_WIDTH = 6  # bytes of a window's hash beside its anchor's 64 bits
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


class Segments:
    """The anchored segments of some documents: parallel arrays, in order."""

    def __init__(self, texts: list[bytes | None], window: int, gram: int):
        words, self.begins = concat((t or b"").split() for t in texts)
        rolling = Rolling(_hashes.of(words))
        self.words = words
        width = window - gram + 1
        n = len(words) - window + 1
        if n <= 0:
            self.owner = self.start = self.count = self.lead = np.zeros(0, np.int64)
            self.anchor = self.segment = np.zeros(0, np.uint64)
            self.windows = np.zeros((0, _WIDTH), np.uint8)
            return
        grams = rolling.grams(gram)
        # the leftmost smallest shingle of each window: minima of doubling widths
        low, at, have = grams, np.arange(len(grams)), 1
        while have < width:
            step = min(have, width - have)
            left, right = low[: len(low) - step], low[step:]
            at = np.where(left <= right, at[: len(at) - step], at[step:])
            low, have = np.minimum(left, right), have + step
        owner = np.repeat(np.arange(len(texts)), np.diff(self.begins))[:n]
        valid = np.flatnonzero(np.arange(n) + window <= self.begins[owner + 1])
        at, owner = at[valid], owner[valid]
        new = np.flatnonzero(
            np.concatenate([[True], (np.diff(at) != 0) | (np.diff(valid) != 1) | (np.diff(owner) != 0)])
        ) if len(valid) else np.zeros(0, np.int64)
        self.count = np.diff(np.concatenate([new, [len(valid)]]))
        self.start, self.owner = valid[new], owner[new]
        self.lead = at[new] - self.start
        self.anchor = grams[at[new]]
        self.segment = rolling.runs(self.start, self.start + self.count - 1 + window)
        self.windows = rolling.runs(valid, valid + window).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_WIDTH]

    def hashes(self, chosen: np.ndarray) -> pa.Array:
        """The window hashes of some segments, one binary value each."""
        ends = np.cumsum(self.count)
        pick = np.zeros(len(self.windows), bool)
        mark = np.zeros(len(self.windows) + 1, np.int64)
        np.add.at(mark, ends[chosen] - self.count[chosen], 1)
        np.add.at(mark, ends[chosen], -1)
        pick = np.cumsum(mark[:-1]) > 0
        offsets = np.concatenate([[0], np.cumsum(self.count[chosen] * _WIDTH)]).astype(np.int32)
        return pa.Array.from_buffers(
            pa.binary(), len(chosen),
            [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.windows[pick]))]
        )


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _smallest(ids: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct key the row with the smallest id, and whether other ids have it too."""
    order = np.lexsort((ids, *keys))
    same = np.ones(max(0, len(ids) - 1), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    first = np.flatnonzero(np.concatenate([[True], ~same])) if len(ids) else np.zeros(0, np.int64)
    last = np.concatenate([first[1:], [len(ids)]]) - 1 if len(ids) else first
    return order[first], ids[order[last]] != ids[order[first]]


_FIRSTS = "anchor long, segment long, first long, mask long, shared boolean, lead int, windows binary"


def _window_hashes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All window hashes of some segments, and how many each has."""
    offsets = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, values.offset * 4).astype(np.int64)
    data = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, _WIDTH)
    wide = np.zeros((len(data), 8), np.uint8)
    wide[:, :_WIDTH] = data
    return wide.view("<u8").ravel(), np.diff(offsets) // _WIDTH


def _block_masks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From batches (block, anchor, segment, id, several, lead, hot, windows) sorted by block, segment and id: a row for each segment that other ids share in whole or part.

    A hot block's segments come one by one: they are all passed on, with their windows.
    """
    held: list[pa.Table] = []

    def first_rows(table: pa.Table) -> pa.Table:
        """The first row of each segment, and whether others have it too."""
        table = table.combine_chunks()
        block, segment, ids = (table.column(c).to_numpy() for c in ("block", "segment", "id"))
        head = np.flatnonzero(np.concatenate([[True], (np.diff(block) != 0) | (np.diff(segment) != 0)]))
        ends = np.concatenate([head[1:], [len(ids)]]) - 1
        several = np.add.reduceat(table.column("several").to_numpy(zero_copy_only=False).astype(np.int64), head) > 0
        return table.take(pa.array(head)).set_column(
            table.schema.get_field_index("several"), "several", pa.array(several | (ids[ends] != ids[head]))
        )

    def masks() -> pa.RecordBatch:
        table = first_rows(pa.concat_tables(held)).combine_chunks()
        block, ids, lead = (table.column(c).to_numpy() for c in ("block", "id", "lead"))
        shared, hot = (table.column(c).to_numpy(zero_copy_only=False) for c in ("several", "hot"))
        # blocks of two or more distinct segments are compared window by window
        group = np.cumsum(np.concatenate([[True], np.diff(block) != 0])) - 1
        contested = (np.bincount(group)[group] > 1) & ~hot
        mask = np.zeros(len(block), np.uint64)
        if contested.any():
            pick = np.flatnonzero(contested)
            hashes, counts = _window_hashes(table.column("windows").combine_chunks().take(pa.array(pick)))
            owner = np.repeat(np.arange(len(pick)), counts)
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            spot = group[pick][owner] * 256 + (inner - lead[pick][owner] + 128)
            who = ids[pick][owner]
            order = np.lexsort((who, hashes, spot))
            same = np.concatenate([[False], (np.diff(spot[order]) == 0) & (hashes[order][1:] == hashes[order][:-1])])
            start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            late = order[who[order] > who[order][start]]
            np.bitwise_or.at(mask, pick[owner[late]], np.uint64(1) << inner[late].astype(np.uint64))
        out = np.flatnonzero(shared | (mask != 0) | hot)
        some = table.take(pa.array(out))
        windows = pa.array(
            [w if h else None for w, h in zip(some.column("windows").to_pylist(), hot[out].tolist())], pa.binary()
        ) if hot[out].any() else pa.nulls(len(out), pa.binary())
        cols = [
            *(some.column(c).combine_chunks() for c in ("anchor", "segment", "id")), _signed(mask[out]),
            pa.array(shared[out]), some.column("lead").combine_chunks(), windows
        ]
        return pa.RecordBatch.from_arrays(cols, ["anchor", "segment", "first", "mask", "shared", "lead", "windows"])

    for batch in rows:
        if not batch.num_rows:
            continue
        block = batch.column("block").to_numpy()
        cut = int(np.searchsorted(block, block[-1]))
        goes_on = held and held[-1].column("block")[-1].as_py() == block[0]
        if held and (cut or not goes_on):
            if cut:
                held.append(pa.Table.from_batches([batch.slice(0, cut)]))
            yield masks()
            held.clear()
        elif cut:
            held.append(pa.Table.from_batches([batch.slice(0, cut)]))
            yield masks()
            held.clear()
        # of a block that goes on only the first row of each segment is kept
        held.append(first_rows(pa.Table.from_batches([batch.slice(cut)])))
    if held:
        yield masks()


def _hot_masks(firsts: DataFrame) -> DataFrame:
    """Rows (anchor, segment, first, mask) of hot blocks: their windows meet by a join on place and hash."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hashes, counts = _window_hashes(batch.column("windows"))
                inner = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
                take = np.repeat(np.arange(batch.num_rows), counts)
                spot = (inner - batch.column("lead").to_numpy()[take]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array(take)) for c in ("anchor", "segment", "first")), pa.array(spot), _signed(hashes), pa.array(inner.astype(np.int32))],
                    ["anchor", "segment", "first", "spot", "hash", "k"]
                )

    hot = firsts.where("windows IS NOT NULL")
    windows = hot.select("anchor", "segment", "first", "lead", "windows").mapInArrow(
        spread, "anchor long, segment long, first long, spot int, hash long, k int"
    )
    low = windows.groupBy("anchor", "spot", "hash").agg(F.min("first").alias("low"))
    late = windows.join(low, ["anchor", "spot", "hash"]).where("low < first")
    bits = late.groupBy("anchor", "segment").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("late"))
    both = hot.select("anchor", "segment", "first", "shared").join(bits, ["anchor", "segment"], "left")
    return both.where("shared OR late IS NOT NULL").select(
        "anchor", "segment", "first", F.coalesce("late", F.lit(0).cast("long")).alias("mask")
    )


def find_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 12
) -> DataFrame:
    """Rows (id, row, hits): for each document with repeats, its segments (position, windows, mask) that a smaller id holds.

    ``row`` is a hash of the text. Windows have at most 64 shingles, so that a mask fits a long. Ids are integers.
    """
    if not 0 < gram <= window or window - gram >= 64:
        raise ValueError("a window holds 1 to 64 shingles")
    rows = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text")
    )

    @freeing(_forget_words)
    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            s = Segments(texts_of(batch.column("text")).to_pylist(), window, gram)
            take = pa.array(s.owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), batch.column("row").take(take), _signed(s.anchor), _signed(s.segment), pa.array((s.start - s.begins[s.owner]).astype(np.int32)), pa.array(s.count.astype(np.int32))],
                ["id", "row", "anchor", "segment", "at", "count"]
            )

    @freeing(_forget_words)
    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            s = Segments(texts_of(batch.column("text")).to_pylist(), window, gram)
            ids = batch.column("id").to_numpy()[s.owner]
            chosen, several = _smallest(ids, s.segment, s.anchor)
            order = np.argsort(chosen)
            chosen, several = chosen[order], several[order]
            yield pa.RecordBatch.from_arrays(
                [_signed(s.anchor[chosen]), _signed(s.segment[chosen]), pa.array(ids[chosen]), pa.array(several), pa.array(s.lead[chosen].astype(np.int32)), s.hashes(chosen)],
                ["anchor", "segment", "id", "several", "lead", "windows"]
            )

    held = "id long, row long, anchor long, segment long, at int, count int"
    sketch = rows.where(
        F.pmod(F.col("row"), F.lit(SKETCH)) == 0
    ).mapInArrow(narrow, held).groupBy("anchor").agg(F.count_distinct("segment").alias("n"))
    hot = written(
        sketch.where(F.col("n") * SKETCH > BLOCK_SEGMENTS).select("anchor", F.lit(True).alias("hot")), "hot-anchors"
    )
    blocks = rows.select("id", "text").mapInArrow(
        wide, "anchor long, segment long, id long, several boolean, lead int, windows binary"
    ).join(hot, "anchor", "left")
    blocks = blocks.withColumn("hot", F.coalesce("hot", F.lit(False))).withColumn(
        "block", F.when(F.col("hot"), F.xxhash64("anchor", "segment")).otherwise(F.col("anchor"))
    )
    dealt = blocks.repartition(_partitions(docs), "block").sortWithinPartitions("block", "segment", "id")
    names = ["block", "anchor", "segment", "id", "several", "lead", "hot", "windows"]
    firsts = written(dealt.select(*names).mapInArrow(_block_masks, _FIRSTS), "first-segments")
    known = firsts.where("windows IS NULL").select("anchor", "segment", "first", "mask").unionByName(_hot_masks(firsts))
    found = rows.mapInArrow(narrow, held).join(known, ["anchor", "segment"])
    every = F.lit(-1).cast("long")
    mask = F.when(F.col("id") > F.col("first"), every).otherwise(F.col("mask"))
    hits = found.withColumn("mask", mask).where("mask != 0").groupBy("id", "row").agg(
        F.collect_list(F.struct("at", "count", "mask")).alias("hits")
    )
    return hits.select(F.col("id").alias(id_col), F.col("row"), "hits")


def _partitions(docs: DataFrame) -> int:
    """So many that each of about twice the input's bytes holds ``PARTITION_BYTES``, and the session's number at least; that number if the bytes are not known."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, 2 * size // PARTITION_BYTES) if size < 1 << 52 else least


def held_windows(n: int, hits: list[dict], window: int) -> np.ndarray:
    """Which windows of n words the hits mark as standing in a smaller id."""
    mark = np.zeros(max(0, n - window + 1), bool)
    for hit in hits:
        at, count, mask = hit["at"], hit["count"], hit["mask"]
        if mask == -1:
            mark[at : at + count] = True
        else:
            mark[at : at + count] |= (
                np.uint64(mask & 0xFFFFFFFFFFFFFFFF) >> np.arange(count, dtype=np.uint64) & np.uint64(1)
            ).astype(bool)
    return mark


def parsed(held: np.ndarray, window: int) -> list[tuple[int, int, bool]]:
    """The greedy parse: (begin, end, whether it lies across the end of a factor) of each factor in words, in order; literal words are left out.

    A factor is the longest run of held windows from where the parse stands; the parse goes on at its end, and held windows
    that begin before that end are those across it.
    """
    edges = np.flatnonzero(np.diff(np.concatenate([[0], held.astype(np.int8), [0]]))).reshape(-1, 2)
    out, at = [], 0
    for a, b in edges.tolist():
        across = a < at
        out.append((a, b - 1 + window, across))
        at = b - 1 + window
    return out


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 12
) -> DataFrame:
    """One row per document: id, ``n_words``, factor ``spans`` (word offsets, end exclusive) and the words that stay, joined by spaces, as ``kept_text``."""
    hits = find_repeats(docs, id_col=id_col, text_col=text_col, window=window, gram=gram).select(
        F.col(id_col).alias("__id"), F.col("row").alias("__row"), F.col("hits").alias("__hits")
    )
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"))
    rows = rows.join(
        hits.hint("shuffle_hash"),
        (F.col("__doc").cast("long") == F.col("__id")) & (F.xxhash64("__text") == F.col("__row")), "left"
    ).select("__doc", "__text", "__hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text"):
            sizes, spans, kept = [], [], []
            for text, hits in zip(texts_of(batch.column("__text")).to_pylist(), batch.column("__hits").to_pylist()):
                words = (text or b"").split()
                out: list[dict[str, int]] = []
                for a, b, _ in parsed(held_windows(len(words), hits, window), window) if hits else ():
                    if out and a <= out[-1]["end"]:
                        out[-1]["end"] = b
                    else:
                        out.append({"start": a, "end": b})
                words_left = [
                    w for a,
                    b in zip([0, *(x["end"] for x in out)], [*(x["start"] for x in out), len(words)]) for w in words[a:b]
                ]
                sizes.append(len(words))
                spans.append(out)
                kept.append(b" ".join(words_left))
            yield pa.RecordBatch.from_arrays(
                [batch.column("__doc"), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()).cast(pa.string())],
                [id_col, "n_words", "spans", "kept_text"]
            )

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kind = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("spans", span), T.StructField("kept_text", T.StringType())]
    )
    return rows.mapInArrow(run, kind)
