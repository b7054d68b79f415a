"""Lexical retrieval packing with a sharded BM25 inverted index.

Document frequencies and the mean length are counted over all documents. Shards
of at most ``shard_docs`` documents or ``shard_tokens`` ids (one document at
least) are dealt by content: each document's BM25 weights are projected to
``DIMENSIONS`` values, a tree of two means, learnt from about ``SAMPLE`` documents
(a fixed bound) picked by the hash of their ids, is cut into leaves, and leaves
that follow each other in the tree make a shard. A leaf too large for a shard is
cut further by the signs of its vectors' differences from the leaf's mean, and
one of copies, which no content parts, by hash. Only the tree is learnt from a
part; every document is dealt by it.

Each shard holds an inverted index of its documents with BM25 weights. A window
is seeded by the next unused document; the index returns the unused documents of
the shard in order of their score against all terms of the seed (ties: order of
ids), and these fill the window greedily. The document that overflows a window is
cut there and its rest seeds the next window. What the last window of a shard
holds is cut into sequences of powers of two, so nothing is padded. Terms are
token ids.

Neighbours in other shards are not found: the README gives the measured recall.
Windows and their numbers do not depend on the input's order or partitions.

Defined results: a null or empty text has the end id only; every row of the
input is packed, repeated rows and null ids as well; texts of any length are cut
into as many pieces as they need; an empty table gives no pieces; columns beside id
and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import written
from .text import freeing, mix, pieces
from .word_tokenizer import tokenizer

K1, B = 1.2, 0.75
DIMENSIONS = 64
SAMPLE = 40_000  # documents that the tree is learnt from
COUNTED = 1 << 20  # ids that are counted at once
PARTITION_BYTES = 16 << 20  # ids that a partition of shards holds on average, once the session's number of them is too small


class Corpus:
    """What BM25 needs to know of all documents: the idf of each term and the mean length."""

    def __init__(self, n: int, length: int, df: np.ndarray):
        self.n, self.mean = n, max(1.0, length / max(1, n))
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)

    def weights(self, terms: np.ndarray, tf: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        norm = np.asarray(K1 * (1 - B + B * length / self.mean), np.float32)
        return self.idf[terms] * tf * np.float32(K1 + 1) / (tf + norm)


def counted(docs: list[np.ndarray], terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, how often, document) of all documents' distinct ids, by document and term."""
    kind = np.uint32 if len(docs) * terms < 1 << 32 else np.uint64  # the narrower are sorted faster
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.repeat(np.arange(len(docs), dtype=kind) * kind(terms), [len(d) for d in docs])
    both += np.concatenate(docs, dtype=kind)
    both.sort()
    last = np.ones(len(both), bool)
    np.not_equal(both[1:], both[:-1], out=last[:-1])
    at = np.flatnonzero(last)
    both = both[at]
    doc = both // kind(terms)
    return (both - doc * kind(terms)).astype(np.int64), np.diff(at, prepend=-1), doc.astype(np.int64)


def term_counts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of a document, in order, and how often each stands there."""
    terms, counts, _ = counted([ids], int(ids.max(initial=0)) + 1)
    return terms.astype(ids.dtype), counts


def document_frequencies(docs: list[np.ndarray], terms: int) -> np.ndarray:
    """How many of the documents hold each term."""
    return np.bincount(counted(docs, terms)[0], minlength=terms)


class Bm25:
    """An inverted index of one shard: postings of each term with their BM25 weights, by the corpus or else by the shard itself."""

    def __init__(self, docs: list[np.ndarray], terms: int, corpus: Corpus | None = None):
        term, tf, doc = counted(docs, terms)
        self.terms = np.split(term, np.searchsorted(doc, np.arange(1, len(docs))))
        df = np.bincount(term, minlength=terms)
        lengths = np.array([len(d) for d in docs], np.float32)
        corpus = corpus or Corpus(len(docs), int(lengths.sum()), df)
        weight = corpus.weights(term, tf.astype(np.float32), lengths[doc]).astype(np.float64)
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.begin = np.concatenate([[0], np.cumsum(df)])
        self.n = len(docs)

    def scores(self, seed: int) -> np.ndarray:
        terms = self.terms[seed]
        spans = list(zip(self.begin[terms].tolist(), self.begin[terms + 1].tolist()))
        return np.bincount(
            np.concatenate([self.doc[a:b] for a, b in spans]), np.concatenate([self.weight[a:b] for a, b in spans]),
            minlength=self.n
        )

    def keep(self, wanted: np.ndarray) -> None:
        """Drop the postings of all other documents."""
        stays = wanted[self.doc]
        self.begin = np.concatenate([[0], np.cumsum(stays)])[self.begin]
        self.doc, self.weight = self.doc[stays], self.weight[stays]


def _powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(
    docs: list[np.ndarray], window: int, terms: int, corpus: Corpus | None = None
) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of the shard's id arrays, whole and without padding."""
    index = Bm25(docs, terms, corpus)
    used = np.zeros(len(docs), bool)
    indexed = len(docs)
    out: list[tuple[int, int, int, int, int]] = []
    sequence, fill = 0, 0
    held: list[tuple[int, int, int]] = []  # pieces of the open window
    queue: Iterator[int] = iter(())

    def place(d: int) -> bool:
        """Put a document down; whether it filled a window, with its rest in the next one."""
        nonlocal sequence, fill
        start, left, full = 0, len(docs[d]), False
        used[d] = True
        while left:
            n = min(left, window - fill)
            held.append((d, start, n))
            start, left, fill = start + n, left - n, fill + n
            if fill == window:
                at = 0
                for h, s, k in held:
                    out.append((h, s, k, sequence, at))
                    at += k
                held.clear()
                sequence, fill, full = sequence + 1, 0, True
        return full

    for seed in range(len(docs)):
        if used[seed]:
            continue
        current = seed
        while not used[current] or fill:
            if not used[current] and place(current) and not fill:
                break
            free = np.flatnonzero(~used)
            if not len(free):
                break
            if 4 * len(free) < 3 * indexed:
                index.keep(~used)
                indexed = len(free)
            # the document that reaches into the open window is its seed
            score = index.scores(held[-1][0])[free]
            for d in free[np.argsort(-score, kind="stable")].tolist():
                if place(d):
                    break
            if not fill:
                break
            current = held[-1][0]
    # the rest of the shard: powers of two have no padding
    sizes = _powers_of_two(fill)
    at = 0
    for h, s, k in held:
        while k:
            n = min(k, sizes[0] - at)
            out.append((h, s, n, sequence, at))
            s, k, at = s + n, k - n, at + n
            if at == sizes[0]:
                sizes.pop(0)
                sequence, at = sequence + 1, 0
    return out


class Tree:
    """Two means at each inner node; leaves in the order of the tree make shards of about ``size`` documents, each sample standing for ``each``."""

    def __init__(self, sample: np.ndarray, each: float, size: int):
        self.means: list[np.ndarray] = []  # both means of an inner node
        self.below: list[list[int]] = []  # its children: inner nodes, or leaves as -1 - leaf
        held, centres, alike = [], [], []

        todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(sample)), -1, 0)]
        top = 0
        while todo:
            rows, parent, side = todo.pop()
            split = _two_means(sample[rows]) if len(rows) * each > size / 4 else None
            if split is None:
                held.append(len(rows))
                centres.append(sample[rows].mean(axis=0) if len(rows) else np.zeros(sample.shape[1]))
                alike.append(len(rows) > 1 and len(rows) * each > size / 4)
                at = -len(held)
            else:
                means, right = split
                at = len(self.means)
                self.means.append(means)
                self.below.append([0, 0])
                todo += [(rows[right], at, 1), (rows[~right], at, 0)]
            if parent < 0:
                top = at
            else:
                self.below[parent][side] = at
        self.top = top
        self.means = np.array(self.means, np.float32).reshape(-1, 2, sample.shape[1])
        self.centres, self.alike = np.array(centres, np.float32).reshape(len(held), -1), np.array(alike)
        # (first shard, number of shards) of each leaf
        self.shards, shard, full = [], 0, 0.0
        for n in held:
            if full and full + n * each > size:
                shard, full = shard + 1, 0.0
            parts = max(1, int(np.ceil(n * each / size)))
            self.shards.append((shard, parts))
            shard, full = (shard + parts, 0.0) if parts > 1 else (shard, full + n * each)
        self.shards = np.array(self.shards, np.int64)

    def deal(self, vectors: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """The shard of each vector; ``spread`` are hashes that part equal ones."""
        leaf = self.leaves(vectors)
        first, parts = self.shards[leaf].T
        sides = (vectors - self.centres[leaf])[:, : min(16, vectors.shape[1])] > 0
        code = (sides * (1 << np.arange(sides.shape[1])[::-1])).sum(axis=1)
        return first + np.where(self.alike[leaf], np.mod(spread, parts), code * parts >> sides.shape[1])

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros(len(vectors), np.int64)
        todo = [(self.top, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                right = _nearer_second(vectors[rows], self.means[node])
                todo += [(self.below[node][0], rows[~right]), (self.below[node][1], rows[right])]
        return out


def _nearer_second(vectors: np.ndarray, means: np.ndarray) -> np.ndarray:
    return vectors @ (means[1] - means[0]) > (np.square(means[1]).sum() - np.square(means[0]).sum()) / 2


def _two_means(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Both means and which rows are nearer the second; nothing if the rows do not part."""
    if len(vectors) < 2:
        return None
    _, axes = np.linalg.eigh(np.cov(vectors, rowvar=False))
    along = (vectors - vectors.mean(axis=0)) @ axes[:, -1]
    right = along > 0
    for _ in range(10):
        if not right.any() or right.all():
            return None
        means = np.stack([vectors[~right].mean(axis=0), vectors[right].mean(axis=0)]).astype(np.float32)
        now = _nearer_second(vectors, means)
        if (now == right).all():
            break
        right = now
    return (means, right) if right.any() and not right.all() else None


def _projection(terms: int) -> np.ndarray:
    """A row of signs for each term."""
    bits = mix(np.arange(1, terms + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.unpackbits(bits.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32) * 2 - 1


def _vectors(docs: list[np.ndarray], corpus: Corpus, signs: np.ndarray) -> np.ndarray:
    """The BM25 weights of each document, projected and scaled to length one."""
    out = np.zeros((len(docs), DIMENSIONS), np.float32)
    lengths = np.array([len(d) for d in docs], np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // COUNTED)) + 1
    for some in np.split(np.arange(len(docs)), cuts):
        term, tf, doc = counted([docs[i] for i in some], len(signs))
        weight = corpus.weights(term, tf.astype(np.float32), lengths[some][doc])
        begins = np.searchsorted(doc, np.arange(len(some) + 1)).tolist()
        for i, a, b in zip(some.tolist(), begins, begins[1:]):
            out[i] = weight[a:b] @ signs[term[a:b]]
    return out / np.maximum(np.sqrt(np.square(out).sum(axis=1, keepdims=True)), 1e-9)


def _width(terms: int) -> str:
    """The type that ids have between the stages."""
    return "<u2" if terms <= 1 << 16 else "<u4"


def _binary(ids: np.ndarray, begins: np.ndarray) -> pa.Array:
    """The ids from each of ``begins`` to the next as one value."""
    offsets = pa.array(begins * ids.itemsize, pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, offsets.buffers()[1], pa.py_buffer(ids)])


def _arrays(column: pa.Array, terms: int) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), _width(terms)) for x in column]


def _forget_words() -> None:
    """Tokenizers are not needed once all ids are made; their words take the memory that shuffles need."""
    tokenizer.cache_clear()


def _tokens(docs: DataFrame, path: str, end: int, size: int) -> DataFrame:
    """Rows (__id, ids, counted): the documents, and from each task a row whose ``ids`` are (term, documents) pairs of 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, df, n, length, kind = tokenizer(path), np.zeros(size, np.int64), 0, 0, None
        for batch in pieces(batches, "__text", 8 << 20):
            own = words.lists(batch.column("__text"))
            ids = np.insert(own.ids.astype(_width(size)), own.begins[1:], end)
            begins = own.begins + np.arange(len(own.begins))
            kind, n, length = batch.schema.field(0).type, n + batch.num_rows, length + len(ids)
            df += document_frequencies(np.split(ids, begins[1:-1]), size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _binary(ids, begins), pa.array(np.zeros(batch.num_rows, bool))],
                ["__id", "ids", "counted"]
            )
        if n:
            terms = np.flatnonzero(df)
            pairs = np.array([[-1, n], [-2, length], *zip(terms.tolist(), df[terms].tolist())], "<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, kind), pa.array([pairs.tobytes()], pa.binary()), pa.array([True])],
                ["__id", "ids", "counted"]
            )

    kind = T.StructType(
        [T.StructField("__id", docs.schema["__id"].dataType), T.StructField("ids", T.BinaryType()), T.StructField("counted", T.BooleanType())]
    )
    return written(docs.mapInArrow(run, kind), "tokens")


def _corpus(tokens: DataFrame, size: int) -> Corpus:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                pairs = np.frombuffer(x.as_buffer(), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["term", "n"])

    rows = tokens.where("counted").select("ids").mapInArrow(
        run, "term long, n long"
    ).groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = dict(rows)
    df = np.zeros(size, np.int64)
    for term, n in found.items():
        if term >= 0:
            df[term] = n
    return Corpus(found.get(-1, 0), found.get(-2, 0), df)


def _dealt(tokens: DataFrame, corpus: Corpus, size: int, shard_docs: int) -> DataFrame:
    """Rows (__id, ids, shard)."""
    rows = tokens.where("NOT counted").select("__id", "ids")
    picked = rows.where(
        F.pmod(F.xxhash64("__id", F.length("ids")), F.lit(1 << 40)) < min(1.0, SAMPLE / max(1, corpus.n)) * (1 << 40)
    ).select("ids")

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget_words()
        signs = _projection(size)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([v.tobytes() for v in _vectors(_arrays(batch.column(0), size), corpus, signs)], pa.binary())],
                ["v"]
            )

    sample = np.frombuffer(
        b"".join(sorted(bytes(r.v) for r in picked.mapInArrow(sampled, "v binary").collect())), np.float32
    ).reshape(-1, DIMENSIONS)
    tree = Tree(sample, corpus.n / max(1, len(sample)), shard_docs)

    @freeing(_forget_words)
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget_words()
        signs = _projection(size)
        for batch in batches:
            shard = tree.deal(
                _vectors(_arrays(batch.column("ids"), size), corpus, signs), batch.column("spread").to_numpy()
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), batch.column("ids"), pa.array(shard)], ["__id", "ids", "shard"]
            )

    kind = T.StructType([tokens.schema["__id"], tokens.schema["ids"], T.StructField("shard", T.LongType())])
    return rows.withColumn("spread", F.xxhash64("__id", "ids")).mapInArrow(deal, kind)


def pack_documents(
    docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, window: int = 4096,
    shard_docs: int = 1000, shard_tokens: int = 4 << 20
) -> DataFrame:
    """Rows (id, start, length, ids, doc_tokens, sequence_id, offset): the pieces, with their ids as little-endian 32-bit integers in ``ids``."""

    terms = max(tokenizer(path).library.get_vocab_size(), end_id + 1)
    tokens = _tokens(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), path, end_id, terms)
    corpus = _corpus(tokens, terms)

    @freeing(_forget_words)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, arrays, size, open_shard, done = [], [], 0, None, 0

        def shard() -> pa.RecordBatch:
            nonlocal done, size
            rows = pack(arrays, window, terms, corpus)
            d, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*rows))
            ids = [arrays[h][s : s + n].tobytes() for h, s, n, _, _ in rows]
            sizes = np.array([len(a) for a in arrays])[d]
            keys = pa.concat_arrays(names).take(pa.array(d))
            batch = pa.RecordBatch.from_arrays(
                [keys, pa.array(start), pa.array(length), pa.array(ids, pa.binary()), pa.array(sizes), pa.array(sequence + (open_shard << 32) + done), pa.array(offset)],
                kind.names
            )
            done += int(sequence[-1]) + 1
            names.clear()
            arrays.clear()
            size = 0
            return batch

        for batch in batches:
            for i, (x, s) in enumerate(zip(batch.column("ids"), batch.column("shard").to_pylist())):
                if arrays and (s != open_shard or len(arrays) >= shard_docs or size >= shard_tokens):
                    yield shard()
                if s != open_shard:
                    open_shard, done = s, 0
                arrays.append(np.frombuffer(x.as_buffer(), _width(terms)).astype("<u4"))
                names.append(batch.column("__id").slice(i, 1))
                size += len(arrays[-1])
        if arrays:
            yield shard()

    long = T.LongType()
    kind = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("start", long), T.StructField("length", long), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", long), T.StructField("sequence_id", long), T.StructField("offset", long)]
    )
    dealt = _dealt(tokens, corpus, terms, shard_docs)
    wanted = int(corpus.n * corpus.mean) * np.dtype(_width(terms)).itemsize // PARTITION_BYTES
    few = wanted <= int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = dealt.repartition("shard") if few else dealt.repartition(wanted, "shard")
    return parted.sortWithinPartitions("shard", "__id", F.xxhash64("ids")).mapInArrow(run, kind)
