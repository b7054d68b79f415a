"""SimHash near-duplicates through shards of BK-trees.

A fingerprint's bit is 1 if it is set in over half of the hashes of the text's
``shingle``-word shingles. Two fingerprints within ``RADIUS`` = 2 bits agree on
at least two of four 16-bit blocks, so each distinct fingerprint goes to the six
shards named by a pair of blocks and their values; no link is lost and shards
stay small. In each shard a BK-tree (children keyed by the Hamming distance to
their parent) answers all radius queries of the shard at once, level by level:
a query follows only edges whose key lies within the radius of the node's own
distance. Shard trees are sent to the task that holds the shard, not broadcast
to all: fingerprints grow with the input and have no proven bound. Shards of more
than ``SHARD_PRINTS`` fingerprints are split so that any two still meet. Each
shard yields a spanning forest, never all pairs.

Near copies at a stated similarity (:func:`similar_groups`) use the same trees
with a wider radius to propose links, and settle each on the exact shingles.

Defined results: null and wordless texts have fingerprint zero and link like any
other; rows with one id are one document; null ids get a fingerprint and no
component. Ids are whole numbers; others raise a TypeError. Texts count whole at
any length; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import smallest_reachable
from .shards import split_hot, whole_shards
from .storage import written
from .text import Rolling, WordHashes, concat, freeing, mix, pieces, texts_of

RADIUS = 2
SHARD_PRINTS, SHARD_TEXTS = 500, 2000  # rows that one key of a shuffle may hold before it is split
_hashes = WordHashes(seed=7)


def _forget_words() -> None:
    _hashes.clear()


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([size(joined, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = np.concatenate([[0], ends[:-shingle] + 1]).tolist()
        hashes = np.fromiter(
            (size(joined[a:b], 42) for a, b in zip(begins, ends[shingle - 1 :].tolist())), np.uint64, len(begins)
        )
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        counts += np.add.reduce(
            np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0,
            dtype=np.uint32
        )
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (id, fingerprint as a signed 64-bit long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text", 1 << 23):
            found = np.array([fingerprint(t, shingle) for t in texts_of(batch.column("__text")).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], [id_col, "fingerprint"])

    kind = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fingerprint", T.LongType())]
    )
    return docs.select(id_col, F.col(text_col).alias("__text")).mapInArrow(run, kind)


class BkTree:
    """A tree over an array of 64-bit values, in their order: children hold the later ones, by their distance to the node."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in range(len(values))]
        plain = values.tolist()
        for i in range(1, len(plain)):
            x, node = plain[i], 0
            while (step := self.children[node].get(d := (plain[node] ^ x).bit_count())) is not None:
                node = step
            self.children[node][d] = i

    def pairs(self, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each value's index with the later ones within the radius."""
        todo = [(0, np.arange(1, len(self.values)))] if len(self.values) > 1 else []
        while todo:
            node, asked = todo.pop()
            d = np.bitwise_count(self.values[asked] ^ self.values[node]).astype(np.int16)
            if len(near := asked[d <= radius]):
                yield node, near
            for e, child in self.children[node].items():
                if len(below := asked[(asked > child) & (np.abs(d - e) <= radius)]):
                    todo.append((child, below))


class Groups:
    """The smallest index that each of n entries reaches over the links seen so far."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> None:
        roots = np.unique(np.append(self.root[others], self.root[i]))
        if len(roots) == 2:
            self.root[self.root == roots[1]] = roots[0]
        elif len(roots) > 2:
            self.root[np.isin(self.root, roots)] = roots[0]

    def links(self) -> Iterator[tuple[int, int]]:
        later = np.flatnonzero(self.root != np.arange(len(self.root)))
        return zip(later.tolist(), self.root[later].tolist())


def _reachable(values: np.ndarray, radius: int) -> Groups:
    groups = Groups(len(values))
    for i, near in BkTree(values).pairs(radius):
        groups.join(i, near)
    return groups


def spanning_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of each shard, from batches (shard, fingerprint, node) sorted by shard."""
    for shards, table in whole_shards(batches):
        u, v = [], []
        prints, nodes = table.column("fingerprint").to_numpy().view(np.uint64), table.column("node").to_numpy()
        for a, b in shards:
            for i, j in _reachable(prints[a:b], radius).links():
                u.append(nodes[a + i])
                v.append(nodes[a + j])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _proposed(shards: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) of all shards (shard, fingerprint, node)."""
    dealt = split_hot(
        written(shards, "shards"), "shard", "node", SHARD_PRINTS
    ).repartition("shard").sortWithinPartitions("shard", "node")
    return dealt.select("shard", "fingerprint", "node").mapInArrow(
        lambda batches: spanning_links(batches, radius), "u long, v long"
    )


def _whole_number(docs: DataFrame, id_col: str) -> Column:
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"ids are whole numbers; {id_col} is {docs.schema[id_col].dataType.simpleString()}")
    return F.col(id_col).cast("long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (id, fingerprint, component_id): the smallest id reachable by links of up to two bits."""
    own = _whole_number(docs, id_col)
    prints = written(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    nodes = prints.groupBy("fingerprint").agg(F.min(id_col).cast("long").alias("node")).where("node IS NOT NULL")
    block = [F.shiftrightunsigned("fingerprint", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    shards = [
        F.lit(n << 32).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j]) for n,
        (i, j) in enumerate(combinations(range(4), 2))
    ]
    found = _proposed(nodes.select(F.explode(F.array(*shards)).alias("shard"), "fingerprint", "node"), RADIUS)
    # rows that share an id are one document, whatever their fingerprints
    same = prints.where(F.col(id_col).isNotNull()).groupBy(own.alias("id")).agg(
        F.min("fingerprint").alias("a"), F.max("fingerprint").alias("b")
    ).where("a != b")
    twice = prints.join(
        same.select(F.col("id").alias(id_col)), id_col, "left_semi"
    ).join(nodes, "fingerprint").select(own.alias("u"), F.col("node").alias("v"))
    component = smallest_reachable(found.unionByName(twice))
    label = nodes.join(component, "node", "left").select(
        "fingerprint", F.coalesce("component", "node").alias("component_id")
    )
    out = prints.join(label, "fingerprint", "left")
    return out.select(
        id_col, "fingerprint", F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id")
    )


SIGNATURE = 128
_SEEDS = mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _shingles(texts: list[bytes | None], shingle: int) -> Iterator[np.ndarray]:
    """The sorted hashes of the distinct shingles of each text; a text of fewer words is one shingle, one without words has none."""
    words, begins = concat((t or b"").lower().split() for t in texts)
    rolling = Rolling(_hashes.of(words))
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
        first = np.arange(a, max(a + 1, b - shingle + 1)) if a < b else np.zeros(0, np.int64)
        yield np.unique(rolling.runs(first, np.minimum(first + shingle, b)))


def _minima(shingles: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the shingles under each of n hashes."""
    low = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(low, mix(shingles[at : at + 4096, None] ^ _SEEDS[:n]).min(axis=0), out=low)
    return low


def settled(sets: list[np.ndarray], similarity: float, radius: int) -> Groups:
    """Groups of the shingle sets over links of ``similarity`` or more between sets whose fingerprints lie within the radius.

    The tree proposes pairs. Pairs of one group already, of too different sizes, or whose minima agree in far fewer places than
    they would (five standard errors) are passed over; all others are compared whole.
    """
    groups = Groups(len(sets))
    sizes = np.array([len(x) for x in sets])
    prints = np.array([_majority(x) if len(x) else 0 for x in sets], np.uint64)
    signs = np.array([_minima(x, SIGNATURE) for x in sets], np.uint64) & np.uint64(0xFFFF)
    least = math.ceil(SIGNATURE * (similarity - 5 * math.sqrt(similarity * (1 - similarity) / SIGNATURE)))
    for i, near in BkTree(prints).pairs(radius):
        near = near[
            (groups.root[near] != groups.root[i]) & (np.minimum(sizes[near], sizes[i]) >= similarity * np.maximum(sizes[near], sizes[i]))
        ]
        for at in range(0, len(near), 4096):
            some = near[at : at + 4096]
            for j in some[np.count_nonzero(signs[some] == signs[i], axis=1) >= least].tolist():
                if groups.root[j] != groups.root[i]:
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if common >= similarity * (sizes[i] + sizes[j] - common):
                        groups.join(i, np.array([j]))
    return groups


def similar_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8,
    radius: int = 20, bands: int = 8
) -> DataFrame:
    """Rows (id, component_id) of the documents in groups linked by a share of equal distinct shingles of ``similarity`` or more.

    Fingerprints are made of distinct shingles. At a similarity of 0.8 they
    differ in 9.7 of 64 bits with a standard deviation of 2.9, so the trees'
    ``radius`` of 20 lies 3.6 deviations beyond, too far for equal blocks of bits
    to name shards: pairs of shingle minima name them, and two texts share one of
    ``bands`` shards with the chance 1 - (1 - similarity**2)**bands (0.9997 at
    0.8). What the trees propose is joined over all shards; each such component
    is brought together with its texts once, proposed links are looked up in a
    tree again and settled on the shingles (by their 64-bit hashes). Components
    of more than ``SHARD_TEXTS`` texts are split so that any two texts still meet.
    """
    own = _whole_number(docs, id_col)

    @freeing(_forget_words)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = list(_shingles(texts_of(batch.column("text")).to_pylist(), shingle))
            keep = np.array([i for i, x in enumerate(sets) if len(x)], np.int64)
            minima = np.array([_minima(sets[i], 2 * bands) for i in keep], np.uint64).reshape(-1, 2 * bands)
            shards = mix(minima[:, 0::2] * np.uint64(3) + mix(minima[:, 1::2]) + np.arange(bands, dtype=np.uint64))
            prints = np.array([_majority(sets[i]) for i in keep], np.uint64)
            whole = np.array([xxhash.xxh64_intdigest(sets[i].tobytes(), 42) for i in keep], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(keep)), pa.array(prints.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(list(shards.view(np.int64)), pa.list_(pa.int64()))],
                ["id", "fingerprint", "whole", "shards"]
            )

    rows = docs.where(F.col(id_col).isNotNull()).select(own.alias("id"), F.col(text_col).alias("text"))
    sketched = written(rows.mapInArrow(run, "id long, fingerprint long, whole long, shards array<long>"), "sketches")
    # texts with the same shingles are one node, and so are rows with one id
    nodes = sketched.groupBy("fingerprint", "whole").agg(F.min("id").alias("node"), F.first("shards").alias("shards"))
    equal = sketched.select("id", "fingerprint", "whole").join(
        nodes.select("fingerprint", "whole", "node"), ["fingerprint", "whole"]
    ).select(F.col("id").alias("u"), F.col("node").alias("v")).where("u != v")
    near = smallest_reachable(
        _proposed(nodes.select(F.explode("shards").alias("shard"), "fingerprint", "node"), radius)
    )

    @freeing(_forget_words)
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shards, table in whole_shards(batches):
            u, v = [], []
            node = table.column("node").to_numpy()
            for a, b in shards:
                sets = [
                    x for p in pieces(table.slice(a, b - a).to_batches(), "text") for x in _shingles(texts_of(p.column("text")).to_pylist(), shingle)
                ]
                for i, j in settled(sets, similarity, radius).links():
                    u.append(node[a + i])
                    v.append(node[a + j])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    named = split_hot(
        written(near.select("node", F.col("component").alias("shard")), "proposed"), "shard", "node", SHARD_TEXTS
    )
    texts = rows.withColumnRenamed("id", "node").join(named, "node")
    found = texts.repartition("shard").sortWithinPartitions("shard", "node").select(
        "shard", "node", "text"
    ).mapInArrow(links, "u long, v long")
    return smallest_reachable(found.unionByName(equal)).select(
        F.col("node").alias(id_col), F.col("component").alias("component_id")
    )


def first_of_each(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8
) -> DataFrame:
    """The documents, all their columns, of which none but the smallest id of each group stays.

    Texts without words, and rows with a null id, are in no group and stay; so do all rows with the smallest id.
    """
    groups = similar_groups(docs, id_col=id_col, text_col=text_col, shingle=shingle, similarity=similarity)
    gone = groups.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone"))
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
