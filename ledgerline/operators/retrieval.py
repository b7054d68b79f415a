"""Filtered text, vector and fused retrieval for batches of questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .. import vocabulary as V
from ..functions.stemming import stems
from ..functions.text import normal_ticker_value, terms

FILTERS = ("ticker", "fiscal_year", "fiscal_period", "section")
CHUNK_COLUMNS = (
    "id", "accession_no", "cik", "ticker", "fiscal_year", "fiscal_period", "section", "chunk_index", "text",
    "token_count", "source_url"
)


def _value(key: str, value: object) -> object:
    if value is None:
        return None
    if key == "fiscal_year":
        if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
            raise ValueError(f"fiscal_year {value!r} is not a positive integer")
        return value
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{key} {value!r} is not a text")
    if key == "ticker":
        return normal_ticker_value(value)
    if key == "fiscal_period":
        if value.strip().upper() not in V.PERIODS:
            raise ValueError(f"fiscal_period {value!r} is unknown")
        return value.strip().upper()
    return value.strip()


def metadata_predicate(filters: dict[str, object] | None) -> Column:
    """All of the filters; a list means any of its values, and a None in it also a null column. Pushed to Parquet as it is."""
    out = F.lit(True)
    for key, given in (filters or {}).items():
        if key not in FILTERS:
            raise ValueError(f"no filter {key!r}")
        values = list(dict.fromkeys(_value(key, v) for v in (given if isinstance(given, (list, tuple)) else [given])))
        if not values:
            raise ValueError(f"{key} has no values")
        known = [v for v in values if v is not None]
        clause = F.col(key).isin(*known) if len(known) > 1 else F.col(key) == known[0] if known else F.lit(False)
        out &= clause | F.col(key).isNull() if None in values else clause
    return out


def checked_k(k: int) -> None:
    if isinstance(k, bool) or not isinstance(k, int) or k <= 0:
        raise ValueError("k is not a positive integer")


def checked_request(query: str, k: int) -> None:
    if not isinstance(query, str) or not query.strip():
        raise ValueError("the query is blank")
    checked_k(k)


def top_k(scored: DataFrame, k: int, *order: Column, group: str = "qid", rank: str = "rank") -> DataFrame:
    """The first k of each question with ranks from 1; Spark keeps k a task before the shuffle."""
    return scored.withColumn(
        rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))
    ).where(F.col(rank) <= k)


def _terms(column: str, stemmed: bool) -> Column:
    return stems(terms(column)) if stemmed else terms(column)


def in_blocks(rows: Iterator, most: int) -> Iterator[list]:
    while block := list(islice(rows, most)):
        yield block


#: Counts or scores that a task holds at once, and the share of a block's questions that makes a term one of the frequent ones.
MATRIX, OFTEN = 1 << 21, 0.05
#: Cosines are held apart by at least this, so that rounding decides nothing; so many pairs are scored exactly at once.
SLACK, PAIRS = 1e-9, 1 << 16


class _TermIndex:
    """Which of a block of questions ask for a term. Frequent terms are counted by a matrix product, others place by place."""

    def __init__(self, asked: list[tuple[object, list[str]]]):
        self.names = [n for n, _ in asked]
        places: dict[str, list[int]] = {}
        for i, (_, words) in enumerate(asked):
            for w in dict.fromkeys(words or []):
                places.setdefault(w, []).append(i)
        self.often = sum(len(qs) > max(8, OFTEN * len(asked)) for qs in places.values())
        # the most frequent first
        known = sorted(places, key=lambda w: -len(places[w]))
        self.ids = {w: i for i, w in enumerate(known)}
        self.askers = np.array([q for w in known for q in places[w]], np.int64)
        self.begin = np.cumsum([0, *(len(places[w]) for w in known)])
        self.wanted = np.zeros((self.often, len(asked)), np.float32)
        for i in range(self.often):
            self.wanted[i, self.askers[self.begin[i] : self.begin[i + 1]]] = 1

    def coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of some texts, -1 for those that nobody asks for, and where each text begins."""
        known = pc.dictionary_encode(texts.flatten())
        of = np.array([self.ids.get(w, -1) for w in known.dictionary.to_pylist()] or [-1], np.int64)
        sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy()
        return of[known.indices.to_numpy()] if len(known) else np.zeros(0, np.int64), np.cumsum([0, *sizes])

    def counts(self, term: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """(texts x questions): at how many places of a text any term of the question stands. Single floats hold such numbers exactly up to 2**24."""
        n, asking = len(begin) - 1, len(self.names)
        row = np.repeat(np.arange(n), np.diff(begin))
        term = term[begin[0] : begin[-1]]
        many = (term >= 0) & (term < self.often)
        held = np.bincount(row[many] * self.often + term[many], minlength=n * self.often).reshape(n, self.often)
        out = held.astype(np.float32) @ self.wanted
        # each other term of a text once, with its count
        pair, tf = np.unique(row[term >= self.often] * len(self.ids) + term[term >= self.often], return_counts=True)
        row, term = pair // max(1, len(self.ids)), pair % max(1, len(self.ids))
        each = self.begin[term + 1] - self.begin[term]
        asker = self.askers[
            np.repeat(self.begin[term] - np.cumsum(each) + each, each) + np.arange(each.sum())
        ]
        rare = np.bincount(np.repeat(row, each) * asking + asker, np.repeat(tf, each), minlength=n * asking)
        return out + rare.reshape(n, asking).astype(np.float32)


def _term_counts(
    questions: DataFrame, chunks: DataFrame, stemmed: bool, block: int, kind: str,
    made: Callable[[_TermIndex, Iterator[tuple[np.ndarray, np.ndarray]]], Iterator[pa.RecordBatch]]
) -> DataFrame:
    """What ``made`` yields for the (ids, counts) of a task's chunks and up to ``block`` questions; terms are cut by the same expression on both sides."""
    rows = chunks.select(F.col("id").cast("long").alias("id"), _terms("text", stemmed).alias("terms"))

    def scorer(index: _TermIndex) -> Callable:
        shared = chunks.sparkSession.sparkContext.broadcast(index)

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            index = shared.value
            for batch in batches:
                ids, (term, begin) = batch.column("id").to_numpy(), index.coded(batch.column("terms"))
                # a bounded matrix of counts at a time
                for at in range(0, len(ids), step := max(1, MATRIX // len(index.names))):
                    yield ids[at : at + step], index.counts(term, begin[at : at + step + 1])

        return lambda batches: made(shared.value, counted(batches))

    found = chunks.sparkSession.createDataFrame([], kind)
    asked = questions.select("qid", _terms("query", stemmed).alias("terms")).toLocalIterator()
    for part in in_blocks(((r[0], r[1]) for r in asked), block):
        found = found.unionByName(rows.mapInArrow(scorer(_TermIndex(part)), kind))
    return found


def cosines(x: np.ndarray, units: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """The cosine of each row with its unit vector, the same for equal rows wherever they stand."""
    return (x * units).sum(axis=1) / norm


class Best:
    """The k best rows of each question over all that a task sees, if above ``least``; ties go to the smaller id.

    The k-th best of what was seen is a floor: of a matrix of scores only what reaches it is looked at.
    """

    def __init__(self, names: list, k: int, least: float = -np.inf):
        self.names, self.k = names, k
        self.floor = np.full(len(names), least)
        self.floor_id = np.full(len(names), np.iinfo(np.int64).min)
        self.held = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, ids: np.ndarray, scores: np.ndarray, exact: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
        """Scores (rows x questions), first of a few rows, so that there are floors for the others.

        With ``exact``, of places of rows and questions, scores are true to SLACK only, and what may reach a floor is scored by it.
        """
        at = 0
        while at < len(ids):
            step = len(ids) if len(self.held[0]) else 2 * self.k
            self._look(ids[at : at + step], scores[at : at + step], (lambda r, q, at=at: exact(r + at, q)) if exact else None)
            at += step

    def _look(self, ids: np.ndarray, scores: np.ndarray, exact: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> None:
        if exact:
            return self._near(ids, scores, exact)
        floor = self.floor.astype(scores.dtype)
        # ties with a k-th best are looked at, ties with ``least`` are none
        full = self.floor_id > np.iinfo(np.int64).min
        row, asker = np.nonzero(scores > np.where(full, np.nextafter(floor, scores.dtype.type(-np.inf)), floor))
        self.take(asker, scores[row, asker].astype(np.float64), ids[row])

    def _near(self, ids: np.ndarray, scores: np.ndarray, exact: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        row, asker = np.nonzero(scores >= self.floor - SLACK)
        for at in range(0, len(row), PAIRS):
            r, q = row[at : at + PAIRS], asker[at : at + PAIRS]
            self.take(q, exact(r, q), ids[r])

    def take(self, asker: np.ndarray, score: np.ndarray, found: np.ndarray) -> None:
        """Single pairs of a question's place and a row's id, with their scores."""
        kept = (score > self.floor[asker]) | ((score == self.floor[asker]) & (found < self.floor_id[asker]))
        self.new.append((asker[kept], score[kept], found[kept]))
        # sorting costs as much as what is held: not for a few rows
        if sum(len(x[0]) for x in self.new) > len(self.held[0]) // 2:
            self._merge()

    def _merge(self) -> None:
        asker, score, found = (np.concatenate(x) for x in zip(self.held, *self.new))
        by = np.lexsort((found, -score, asker))
        asker, score, found = asker[by], score[by], found[by]
        begin = np.searchsorted(asker, np.arange(len(self.names) + 1))
        kept = np.arange(len(asker)) - begin[asker] < self.k
        full = np.flatnonzero(np.diff(begin) >= self.k)
        last = begin[full] + self.k - 1
        self.floor[full], self.floor_id[full] = score[last], found[last]
        self.held, self.new = (asker[kept], score[kept], found[kept]), []

    def rows(self, qid_type: pa.DataType, column: str) -> pa.RecordBatch:
        self._merge()
        asker, score, found = self.held
        return pa.RecordBatch.from_arrays([pa.array(self.names, qid_type).take(pa.array(asker)), pa.array(found), pa.array(score)], ["qid", "id", column])


def text_search(
    questions: DataFrame, chunks: DataFrame, k: int, filters: dict[str, object] | None = None, *, stemmed: bool = False,
    block: int = 16_384
) -> DataFrame:
    """Rows (qid, id, text_score, rank): chunks that hold any term of the question, 0.1 for each place where one stands.

    Questions (qid, query) are a stated set: it is broadcast in blocks of ``block``, each batch of chunks counts the terms of
    all of a block's questions at once, and only a task's best k of each are shuffled. A question without terms finds nothing.
    With ``stemmed``, words match by their English stems.
    """
    checked_k(k)
    kind = to_arrow_type(questions.schema["qid"].dataType)

    def made(index: _TermIndex, counted: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        best = Best(index.names, k, 0)
        for ids, counts in counted:
            best.add(ids, counts)
        yield best.rows(kind, "places")

    found = _term_counts(
        questions, chunks.where(metadata_predicate(filters)), stemmed, block,
        f"qid {questions.schema['qid'].dataType.simpleString()}, id long, places double", made
    )
    return top_k(found, k, F.desc("places"), F.asc("id")).select(
        "qid", "id", (F.col("places") * 0.1).alias("text_score"), "rank"
    )


def text_match_counts(
    questions: DataFrame, chunks: DataFrame, *, stemmed: bool = False, block: int = 4096
) -> DataFrame:
    """Rows (qid, matches), zero where nothing matches. Ids of chunks are distinct."""
    kind = to_arrow_type(questions.schema["qid"].dataType)
    made = lambda index, counted: (pa.RecordBatch.from_arrays([pa.array(index.names, kind), pa.array(np.count_nonzero(counts, axis=0))], ["qid", "n"]) for _, counts in counted)
    found = _term_counts(
        questions, chunks, stemmed, block, f"qid {questions.schema['qid'].dataType.simpleString()}, n long", made
    ).groupBy("qid").agg(F.sum("n").alias("n"))
    return questions.select("qid").join(found, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("matches"))


def vector_search(
    questions: DataFrame, chunks: DataFrame, k: int, filters: dict[str, object] | None = None, *,
    dimensions: int | None = None, block: int = 4096
) -> DataFrame:
    """Rows (qid, id, vector_score, rank) by exact cosine similarity in double precision; ties go to the smaller id.

    Questions (qid, embedding) are a stated set: it is broadcast in blocks of ``block`` vectors, so the chunks are read once
    for so many questions; each task yields its own best k of each, and only those are shuffled. Null, zero and
    wrongly sized vectors match nothing.
    """
    checked_k(k)
    spark = chunks.sparkSession
    qid_type = to_arrow_type(questions.schema["qid"].dataType)
    rows = chunks.where(
        metadata_predicate(filters) & F.col("embedding").isNotNull()
    ).select(F.col("id").cast("long").alias("id"), "embedding")

    def scorer(names: list, matrix: np.ndarray) -> Callable:
        shared = spark.sparkContext.broadcast((names, matrix))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix = shared.value
            best = Best(names, k)
            for batch in batches:
                for at in range(0, batch.num_rows, step := max(1, MATRIX // len(names))):
                    part = batch.slice(at, step)
                    vectors = part.column("embedding")
                    sized = pc.equal(pc.list_value_length(vectors), matrix.shape[1])
                    ids = part.column("id").filter(sized).to_numpy()
                    if not len(ids):
                        continue
                    x = vectors.filter(sized).flatten().to_numpy(
                        zero_copy_only=False
                    ).astype(np.float64).reshape(len(ids), -1)
                    norm = np.linalg.norm(x, axis=1)
                    good = np.isfinite(norm) & (norm > 0)
                    x, norm = x[good], norm[good]
                    # a product of matrices rounds equal rows apart, a sum over a pair does not
                    best.add(ids[good], x / norm[:, None] @ matrix.T, lambda r, q: cosines(x[r], matrix[q], norm[r]))  # noqa: B023
            yield best.rows(qid_type, "vector_score")

        return run

    def valid(qid: object, vector: list | None) -> tuple[object, list]:
        if vector is None or (dimensions and len(vector) != dimensions) or not all(
            x is not None and np.isfinite(x) for x in vector
        ):
            raise ValueError(f"the vector of question {qid!r} is not valid")
        return qid, vector

    kind = f"qid {questions.schema['qid'].dataType.simpleString()}, id long, vector_score double"
    found = spark.createDataFrame([], kind)
    for part in in_blocks((valid(*r) for r in questions.select("qid", "embedding").toLocalIterator()), block):
        matrix = np.array([v for _, v in part], np.float64)
        norm = np.linalg.norm(matrix, axis=1, keepdims=True)
        found = found.unionByName(
            rows.mapInArrow(scorer([q for q, _ in part], matrix / np.where(norm > 0, norm, 1)), kind)
        )
    return top_k(found, k, F.desc("vector_score"), F.asc("id"))


#: A search of questions in chunks: the k best of each under some filters.
Search = Callable[[DataFrame, DataFrame, int, dict[str, object] | None], DataFrame]


def fuse(text: DataFrame, vector: DataFrame, k: int, *, rrf_k: int = 60, text_cap: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: rows (qid, id, text_score, vector_score, rrf_score, best_rank, rank).

    Ties go to the better single rank, then to the smaller id. ``text_cap`` keeps only the first ranks of the text list.
    """
    if text_cap is not None:
        text = text.where(F.col("rank") <= text_cap)
    both = text.select("qid", "id", "text_score", F.col("rank").alias("__t")).join(
        vector.select("qid", "id", "vector_score", F.col("rank").alias("__v")), ["qid", "id"], "full_outer"
    )
    score = F.coalesce(1 / (rrf_k + F.col("__t")), F.lit(0.0)) + F.coalesce(1 / (rrf_k + F.col("__v")), F.lit(0.0))
    fused = both.select(
        "qid", "id", "text_score", "vector_score", score.alias("rrf_score"), F.least("__t", "__v").alias("best_rank")
    )
    return top_k(fused, k, F.desc("rrf_score"), F.asc("best_rank"), F.asc("id"))


#: each list of a hybrid search is so many times as long as the result
WIDEN = 3


def hybrid_search(
    questions: DataFrame, chunks: DataFrame, k: int, filters: dict[str, object] | None = None, *, widen: int = WIDEN,
    rrf_k: int = 60, text_cap: int | None = None, text: Search = text_search, vector: Search = vector_search
) -> DataFrame:
    """Fusion of both searches, each over ``widen`` times as many rows. Questions are (qid, query, embedding)."""
    return fuse(
        text(questions, chunks, k * widen, filters), vector(questions, chunks, k * widen, filters), k, rrf_k=rrf_k,
        text_cap=text_cap
    )


Scorer = Callable[[list[str], list[str]], list[float]]


def overlap_scorer(queries: list[str], texts: list[str]) -> list[float]:
    """A deterministic stand-in for a cross-encoder: the share of the query's words that the text holds."""
    out = []
    for q, t in zip(queries, texts):
        wanted = set(q.lower().split())
        out.append(len(wanted & set(t.lower().split())) / max(1, len(wanted)))
    return out


def pair_scores(
    pairs: DataFrame, questions: DataFrame, chunks: DataFrame, scorer: Scorer = overlap_scorer
) -> DataFrame:
    """Rows (qid, id, rerank_score) of pairs (qid, id): a table of scores, so that a pair in many lists is scored once.

    Scores must be finite, one for each row.
    """
    rows = pairs.select("qid", "id").join(chunks.select("id", "text"), "id").join(
        questions.select("qid", "query"), "qid"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = scorer(batch.column("query").to_pylist(), batch.column("text").to_pylist())
            if len(scores) != batch.num_rows or not np.isfinite(scores).all():
                raise ValueError("the reranker's scores are not one finite number for each row")
            yield pa.RecordBatch.from_arrays(
                [batch.column("qid"), batch.column("id"), pa.array(scores, pa.float64())], ["qid", "id", "rerank_score"]
            )

    kind = f"qid {pairs.schema['qid'].dataType.simpleString()}, id {pairs.schema['id'].dataType.simpleString()}, rerank_score double"
    return rows.select("qid", "id", "query", "text").mapInArrow(run, kind)


def reranked(ranked: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    """The first n of each question by a table of scores, ties in their former order."""
    rows = ranked.select("qid", "id", F.col("rank").alias("before")).join(scores, ["qid", "id"])
    return top_k(rows, n, F.desc("rerank_score"), F.asc("before"))


def rerank(
    ranked: DataFrame, questions: DataFrame, chunks: DataFrame, n: int, scorer: Scorer = overlap_scorer
) -> DataFrame:
    """The first n of each question by the scorer, ties in their former order."""
    return reranked(ranked, pair_scores(ranked, questions, chunks, scorer), n)


#: Filters that may be dropped where a question finds nothing.
PERIOD_FILTERS = ("fiscal_year", "fiscal_period")


def retrieve(
    questions: DataFrame, chunks: DataFrame, filters: dict[str, object] | None = None, *,
    strategy: str = "vector_rerank", k: int = 20, n: int = 5, relax: bool = False, scorer: Scorer = overlap_scorer,
    text: Search = text_search, vector: Search = vector_search
) -> DataFrame:
    """One of four strategies. With ``relax``, each question that finds nothing is searched again without the period filters.

    ``text`` and ``vector`` are the searches of both legs: those of all rows, or of indexes at rest.
    """
    both = partial(hybrid_search, text=text, vector=vector)
    search = {"vector": vector, "vector_rerank": vector, "hybrid": both, "hybrid_rerank": both}.get(strategy)
    if search is None:
        raise ValueError(f"no strategy {strategy!r}")
    checked_k(k)
    found = search(questions, chunks, k, filters)
    loose = {f: v for f, v in (filters or {}).items() if f not in PERIOD_FILTERS}
    if relax and loose != (filters or {}):
        empty = questions.join(found.select("qid").distinct(), "qid", "left_anti")
        if not empty.isEmpty():
            found = found.unionByName(search(empty, chunks, k, loose))
    if strategy.endswith("rerank"):
        return rerank(found, questions, chunks, n, scorer)
    return found.where(F.col("rank") <= n)
