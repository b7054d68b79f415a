"""Ranked lexical search over a clustered index with exact stopping.

The index: every document is cut into terms once. Recursive graph bisection
brings documents that share terms together: a tree learnt on a bounded sample
deals all of them to leaves, leaves are cut into shards of bounded size, and each
shard's documents are bisected on, down to clusters. A posting list belongs to a
shard and a term and carries its highest impact.

The search: the bound of a shard for a question is the sum of its terms' highest
impacts there. Each question first visits the shards with the best bounds; the
score of its k-th best document then is the floor for all others: a shard, and in
a shard a cluster, is visited only if its bound reaches the floor. A bound is never
below a score, so what is left out cannot be among the k best, ties included.
Shards answer with their own places, which are mapped back to ids at the end.

Scores are integers. With N documents that have terms, L terms in all of them, n in
one, df documents of a term and tf occurrences in one: a term weighs
floor(1000 ln((2N+2)/(2df+1))) and its impact is 10**9 tf div (1000 tf + 12 m) with
m = 75 + 25 n N div L.

Defined results: null and empty texts have no terms, are not counted and never
found; items without terms get no rows; rows of one item id (null too) are one item
whose terms are those of all; repeated documents are ranked each, null ids before
all others at equal scores; texts count whole; empty tables give no rows; columns
beside the named ones are not read, whatever their names. Terms are compared by
64-bit hashes.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bisection import Tree, features, ordered
from .storage import written
from .text import WordHashes, freeing, pieces, texts_of

#: The upper tree is learnt from about so many documents, and has at most 2 ** DEEPEST leaves.
SAMPLE, DEEPEST = 4096, 8
#: A shard has about this many documents and postings at most; a cluster this many documents.
SHARD_DOCS, SHARD_POSTINGS, CLUSTER = 2048, 1 << 20, 64
#: So many shards a question visits before it has a floor, and so many questions visit a shard together.
FIRST, TOGETHER = 2, 1000

_TERM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_hashes = WordHashes(cap=150_000)


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all characters beyond ASCII; A-Z lowered."""
    return text.translate(_TERM).split()


def _counted(text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    found = Counter(terms(text))
    tf = np.fromiter(found.values(), np.int64, len(found))
    return int(tf.sum()), _hashes.of(list(found)).view(np.int64), tf


def _arrays(column: pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _csr(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    begins = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]).astype(np.int64)
    return begins, np.concatenate(lists) if lists else np.zeros(0, np.int64)


def _forward(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, n, size, terms, tf, spread), one for each document with terms; written once."""

    @freeing(_hashes.clear)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        place = itertools.count()
        for batch in pieces(batches, "text"):
            rows = [_counted(x.as_py() or b"") for x in texts_of(batch.column("text"))]
            kept = [k for k, x in enumerate(rows) if x[0]]
            rows = [rows[k] for k in kept]
            spread = [xxhash.xxh64_intdigest(b"%d %d" % (task, next(place))) >> 1 for _ in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(kept, pa.int64())), pa.array([x[0] for x in rows], pa.int64()),
                    pa.array([len(x[1]) for x in rows], pa.int64()), pa.array([x[1].tobytes() for x in rows], pa.binary()),
                    pa.array([x[2].astype("<i4").tobytes() for x in rows], pa.binary()), pa.array(spread, pa.int64()),
                ], ["id", "n", "size", "terms", "tf", "spread"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = T.StructType([rows.schema["id"]]).add("n", "long").add("size", "long").add("terms", "binary").add("tf", "binary").add("spread", "long")
    return written(rows.mapInArrow(run, kind), "forward")


def _sharded(forward: DataFrame, n_docs: int, shard_docs: int) -> DataFrame:
    """``forward`` with a column ``shard``: a leaf of the tree and a part of the leaf."""
    depth = min(DEEPEST, max(0, math.ceil(math.log2(max(1, n_docs) / shard_docs))))
    rate = min(1.0, SAMPLE / max(1, n_docs))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(features(x)).tobytes() for x in _arrays(batch.column(0), "<i8")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["f"])

    picked = forward.where(F.col("spread") <= min(int(rate * 2**63), 2**63 - 1)).select("terms") if depth else None
    # about SAMPLE rows of at most FEATURES numbers each
    rows = sorted(bytes(r.f) for r in picked.mapInArrow(sampled, "f binary").collect()) if depth else []
    tree = Tree([np.frombuffer(x, np.uint16) for x in rows], depth)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = tree.leaves(*_csr([features(x) for x in _arrays(batch.column("terms"), "<i8")]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    sized = forward.select("size", "terms").mapInArrow(deal, "size long, terms binary, leaf long")
    counts = sized.groupBy("leaf").agg(F.count("*").alias("docs"), F.sum("size").alias("postings")).collect()
    parts = {r.leaf: max(-(-r.docs // shard_docs), -(-r.postings // SHARD_POSTINGS)) for r in counts}
    per_leaf = F.element_at(F.create_map(*[F.lit(x).cast("long") for p in sorted(parts.items()) for x in p]), F.col("leaf")) if parts else F.lit(1)
    dealt = forward.mapInArrow(deal, T.StructType([*forward.schema.fields]).add("leaf", "long"))
    return dealt.withColumn("shard", F.shiftleft("leaf", 32) + F.pmod("spread", per_leaf)).drop("leaf")


def _indexed(table: pa.Table, n_docs: int, n_terms: int) -> pa.Table:
    """The rows of one shard's index: a posting list for each term, the order of ids, and each document's place."""
    shard = table.column("shard")[0].as_py()
    begins, flat = _csr(_arrays(table.column("terms").combine_chunks(), "<i8"))
    _, tf = _csr(_arrays(table.column("tf").combine_chunks(), "<i4"))
    order = ordered(begins, features(flat), CLUSTER)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    m = np.array([75 + 25 * n * n_docs // n_terms for n in table.column("n").to_pylist()], np.int64)
    sizes = np.diff(begins)
    tf = tf.astype(np.int64)
    impact = (10**9 * tf) // (1000 * tf + 12 * np.repeat(m, sizes))
    at = np.repeat(place, sizes)
    by = np.lexsort((at, flat))
    flat, at, impact = flat[by], at[by].astype("<i4"), impact[by].astype("<i4")
    starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    ends = np.append(starts[1:], len(flat))
    places, impacts = at.tobytes(), impact.tobytes()
    ids = table.column("id").combine_chunks()
    ranks = np.empty(len(order), "<i4")
    ranks[place[pc.sort_indices(ids, null_placement="at_start").to_numpy()]] = np.arange(len(order))
    lists, docs = len(starts), len(order)
    empty = pa.nulls(docs, pa.binary())
    return pa.table({
        "shard": pa.array(np.full(lists + 1 + docs, shard)),
        "kind": pa.array(["list"] * lists + ["ranks"] + ["doc"] * docs),
        "term": pa.concat_arrays([pa.array(flat[starts]), pa.nulls(1 + docs, pa.int64())]),
        "n": pa.concat_arrays([pa.array(ends - starts), pa.array(np.append(docs, place))]),
        "top": pa.concat_arrays([pa.array(np.maximum.reduceat(impact, starts).astype(np.int64)), pa.nulls(1 + docs, pa.int64())]),
        "places": pa.concat_arrays([pa.array([places[4 * a : 4 * b] for a, b in zip(starts, ends)] + [ranks.tobytes()], pa.binary()), empty]),
        "impacts": pa.concat_arrays([pa.array([impacts[4 * a : 4 * b] for a, b in zip(starts, ends)] + [b""], pa.binary()), empty]),
        "id": pa.concat_arrays([pa.nulls(lists + 1, ids.type), ids]),
    })


class Index:
    """Written posting lists of all documents; ``lists``, ``ranks`` and ``places`` are DataFrames."""

    def __init__(self, rows: DataFrame, n_docs: int):
        self.n_docs = n_docs
        self.lists = rows.where("kind = 'list'").select("shard", "term", "n", "top", "places", "impacts")
        self.ranks = rows.where("kind = 'ranks'").select("shard", "term", "n", "top", "places", "impacts")
        self.places = rows.where("kind = 'doc'").select("shard", F.col("n").alias("place"), "id")


def build(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS) -> Index:
    forward = _forward(docs, id_col, text_col)
    n_docs, n_terms = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    sharded = _sharded(forward, n_docs, shard_docs)

    def run(table: pa.Table) -> pa.Table:
        found = _indexed(table, n_docs, n_terms)
        # a worker indexes one shard after another and keeps none
        pa.default_memory_pool().release_unused()
        return found

    kind = T.StructType().add("shard", "long").add("kind", "string").add("term", "long").add("n", "long").add("top", "long")
    kind = kind.add("places", "binary").add("impacts", "binary").add(forward.schema["id"])
    return Index(written(sharded.groupBy("shard").applyInArrow(run, kind), "postings"), n_docs)


def _asked(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (item, term, times); written."""

    @freeing(_hashes.clear)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows = [_counted(x.as_py() or b"") for x in texts_of(batch.column("text"))]
            begins, flat = _csr([x[1] for x in rows])
            which = np.repeat(np.arange(len(rows)), np.diff(begins))
            times = _csr([x[2] for x in rows])[1]
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(which)), pa.array(flat), pa.array(times)], ["item", "term", "times"])

    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    kind = T.StructType([rows.schema["item"]]).add("term", "long").add("times", "long")
    return written(rows.mapInArrow(run, kind).groupBy("item", "term").agg(F.sum("times").alias("times")), "questions")


def _answers(lists: pa.Table, visits: pa.Table, k: int) -> tuple[list, list, list, list]:
    """For each visit of one shard its k best places, by score and then id, that reach its floor: (row, place, score, shard)."""
    names = lists.column("term").to_pylist()
    places, impacts = (_arrays(lists.column(c).combine_chunks(), "<i4") for c in ("places", "impacts"))
    ranks = places[names.index(None)]
    known = {t: (p, i.astype(np.int64), p // CLUSTER) for t, p, i in zip(names, places, impacts) if t is not None}
    clusters = -(-len(ranks) // CLUSTER)
    tops: dict[int, np.ndarray] = {}
    out: tuple[list, list, list] = ([], [], [])
    for row in range(visits.num_rows):
        asked = zip(visits.column("terms")[row].as_py(), visits.column("weights")[row].as_py())
        found = [(t, w) for t, w in asked if t in known]
        floor = visits.column("floor")[row].as_py()
        bounds = np.zeros(clusters, np.int64)
        for t, w in found:
            if t not in tops:
                tops[t] = np.zeros(clusters, np.int64)
                np.maximum.at(tops[t], known[t][2], known[t][1])
            bounds += w * tops[t]
        reach = bounds >= floor
        if not reach.any():
            continue
        scores = np.zeros(len(ranks), np.int64)
        for t, w in found:
            p, i, c = known[t]
            if not reach.all():
                keep = reach[c]
                p, i = p[keep], i[keep]
            scores[p] += w * i  # a list names a place once
        best = np.flatnonzero(scores >= floor)
        if len(best) > k:
            best = best[scores[best] >= np.partition(scores[best], len(best) - k)[len(best) - k]]
        best = best[np.lexsort((ranks[best], -scores[best]))][:k]
        for column, values in zip(out, (np.full(len(best), row), best, scores[best])):
            column.append(values)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _visit(lists: DataFrame, pairs: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """Rows (item, shard, place, score) of pairs (item, shard, floor); written."""
    many = max(1, -(-questions.count() // TOGETHER))
    visits = pairs.join(questions, pairs["item"].eqNullSafe(questions["question"])).drop("question")
    part = F.pmod(F.xxhash64("item"), F.lit(many))
    visits = visits.withColumn("block", part)
    open_lists = lists.join(pairs.select("shard", part.alias("__part")).distinct(), "shard")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, place, score = _answers(left, right, k)
        shard = right.column("shard")[0].as_py() if right.num_rows else 0
        return pa.table({
            "item": right.column("item").take(pa.array(row, pa.int64())), "shard": pa.array(np.full(len(row), shard, np.int64)),
            "place": pa.array(place, pa.int64()), "score": pa.array(score, pa.int64()),
        })

    kind = T.StructType([pairs.schema["item"]]).add("shard", "long").add("place", "long").add("score", "long")
    met = open_lists.groupBy("shard", "__part").cogroup(visits.groupBy("shard", "block"))
    return written(met.applyInArrow(run, kind), "hits")


def search(index: Index, items: DataFrame, k: int = 20, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (item, rank, id, score): the k best documents of each item."""
    asked = _asked(items, id_col, text_col)
    open_lists = written(index.lists.join(asked.select("term").distinct(), "term"), "open-lists").select(*index.lists.columns)
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = open_lists.groupBy("term").agg(F.sum("n").alias("df")).select("term", weight.alias("weight"))
    weighted = written(
        asked.join(weights, "term").select("item", "term", (F.col("times") * F.col("weight")).alias("weight")).where("weight > 0"), "weights"
    )
    reach = open_lists.select("shard", "term", "top").join(weighted, "term").groupBy("item", "shard")
    bounds = written(reach.agg(F.sum(F.col("weight") * F.col("top")).alias("bound")), "bounds")
    pairs = F.sort_array(F.collect_list(F.struct("term", "weight")))
    questions = weighted.groupBy(F.col("item").alias("question")).agg(pairs.alias("p"))
    questions = written(questions.select("question", F.col("p.term").alias("terms"), F.col("p.weight").alias("weights")), "asked")
    lists = open_lists.unionByName(index.ranks)

    best_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "shard")
    first = bounds.withColumn("__nr", F.row_number().over(best_bound)).where(F.col("__nr") <= FIRST)
    first = written(first.select("item", "shard", F.lit(1).cast("long").alias("floor")), "first-visits")
    hits = _visit(lists, first, questions, k)
    by_score = Window.partitionBy("item").orderBy(F.desc("score"))
    floors = hits.withColumn("__nr", F.row_number().over(by_score)).where(F.col("__nr") == k)
    floors = floors.select(F.col("item").alias("question"), F.col("score").alias("floor"))
    rest = bounds.join(first.select(F.col("item").alias("question"), F.col("shard").alias("seen")), F.col("item").eqNullSafe(F.col("question")) & (F.col("shard") == F.col("seen")), "left_anti")
    rest = rest.join(floors, F.col("item").eqNullSafe(F.col("question")), "left").select("item", "shard", "bound", F.coalesce("floor", F.lit(1)).cast("long").alias("floor"))
    more = _visit(lists, rest.where("bound >= floor").select("item", "shard", "floor"), questions, k)

    named = hits.unionByName(more).join(index.places, ["shard", "place"])
    in_order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("id"))
    ranked = named.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= k)
    return ranked.select("item", "rank", "id", "score")
