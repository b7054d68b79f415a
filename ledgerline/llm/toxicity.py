"""Toxicity by maximum-scoring segments.

The scan's tokens are beginnings of words, as stems carry the meaning and whole
words (compounds, inflections) are too rare each: of a word's first 2 to
``LONGEST`` letters and the whole word, the beginning with the surest odds
stands for the word. A beginning's score is its log-odds of standing in a toxic
rather than a clean labelled document, counted over tokens with an informative
Dirichlet prior from the tokens of all training documents. The standard error of
these odds is widened as words come in bursts: their variance is multiplied by
the sum of squared counts by document over the count, as in a cluster sample. The
score is the odds less ``z`` standard errors, zero if the odds are not sure. A drift is taken from every
word so that clean text scores below zero. One linear scan finds all maximal
scoring segments of a text. The scores of clean training texts' best segments,
less the logarithm of the length, follow an extreme-value (Gumbel) distribution;
its fit gives each segment's surprise, and segments beyond ``significance`` are
the toxic passages. A logistic curve over the surprises of the best and of all
passages, fitted on the training rows, gives the score.

Defined results: null and empty texts have no passages and get the score of a
text without any; with no training row of either label, or an empty table of
labels, every score is 0. Training texts that repeat with one label count once.
Every row of the input gives one row, also repeated rows and null ids; rows that
tie get equal scores. Texts are scanned whole at any length, in linear time. An empty
table gives no rows; columns beside id and text are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import training_rows
from .storage import written
from .text import freeing, pieces, texts_of

# bytes other than letters become spaces
_LETTERS = bytes(b if b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))
LONGEST = 8
_known: dict[str, tuple[str, ...]] = {}


def _forget_words() -> None:
    _known.clear()


def words(text: bytes | None) -> list[str]:
    return (text or b"").translate(_LETTERS).decode("utf-8", "replace").lower().split()


def beginnings(word: str) -> tuple[str, ...]:
    """What may stand for a word: its first 2 to ``LONGEST`` letters, each with a mark, and the word itself."""
    return (*(word[:n] + "-" for n in range(2, min(len(word), LONGEST + 1))), word)


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score) in one scan: disjoint, in order, none extendable.

    Every candidate knows the nearest one before it that begins lower, so that
    candidates once passed over are not looked at again: linear at any input.
    """
    # each candidate: begin, end, sum of all before it, sum of all up to its end, nearest candidate that begins lower
    held: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for i, x in enumerate(scores):
        before, total = total, total + x
        if x <= 0:
            continue
        begin, left, at = i, before, len(held) - 1
        while True:
            while at >= 0 and held[at][2] >= left:
                at = held[at][4]
            # join with that candidate, unless it ends at least as high
            if at < 0 or held[at][3] >= total:
                break
            begin, _, left, _, below = held[at]
            del held[at:]
            at = below
        held.append((begin, i + 1, left, total, at))
    return [(a, b, high - low) for a, b, low, high, _ in held]


class _WordValues(dict):
    """Word -> score of its surest beginning, remembered for at most ``cap`` words."""

    def __init__(self, scores: dict[str, float], other: float, cap: int = 400_000):
        super().__init__()
        self.scores, self.other, self.cap = scores, other, cap

    def __missing__(self, word: str) -> float:
        if len(self) >= self.cap:
            self.clear()
        found = [self.scores[x] for x in beginnings(word) if x in self.scores]
        # ties: the shortest beginning
        self[word] = value = max(found, key=abs) + self.other if found else self.other
        return value


@dataclass
class Model:
    """Scores of beginnings, the drift, the Gumbel fit and the logistic curve."""

    scores: dict[str, float] = field(default_factory=dict)
    drift: float = 0.15
    scale: float = 1.0
    place: float = 0.0
    spread: float = 1.0
    significance: float = 3.0
    curve: tuple[float, ...] = ()

    def __post_init__(self) -> None:
        self.values = _WordValues(self.scores, -self.drift)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "values"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def segments(self, tokens: list[str]) -> list[tuple[int, int, float]]:
        """Maximal segments of a text's words. Runs of words below zero are summed, which changes no segment."""
        values = np.fromiter(map(self.values.__getitem__, tokens), np.float64, len(tokens))
        up = np.flatnonzero(values > 0)
        if not len(up):
            return []
        sums = np.concatenate([[0], np.cumsum(values)])
        joined: list[float] = []
        for a, b in zip(up.tolist(), up.tolist()[1:] + [None]):
            joined.append(float(values[a]))
            if b is not None:
                joined.append(float(sums[b] - sums[a + 1]))
        return [(int(up[a // 2]), int(up[(b - 1) // 2]) + 1, s) for a, b, s in maximal_segments(joined)]

    def surprise(self, score: float, n: int) -> float:
        """Minus the log of the chance that a clean text of n words has a segment with such a score."""
        z = (self.scale * score - math.log(max(n, 1)) - self.place) / self.spread
        return z if z > 30 else -math.log(-math.expm1(-math.exp(-z)))

    def passages(self, text: bytes | None) -> tuple[list[tuple[int, int, float]], list[float]]:
        """(significant passages as word begin, end and surprise; features of the curve)."""
        tokens = words(text)
        found = [(a, b, self.surprise(s, len(tokens))) for a, b, s in self.segments(tokens)]
        best = max((s for *_, s in found), default=0.0)
        strong = [x for x in found if x[2] >= self.significance]
        inside = sum(b - a for a, b, _ in strong) / max(1, len(tokens))
        return strong, [1.0, math.log1p(best), math.log1p(sum(s for *_, s in strong)), inside]

    def score(self, features: list[float]) -> float:
        if not self.curve:
            return 0.0
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, float(np.dot(features, self.curve))))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def count_beginnings(texts: Iterable[tuple[bytes | None, int]]) -> tuple[dict[str, list[int]], list[int]]:
    """For each beginning its tokens in toxic and in clean texts and the sum of its squared counts by text; and all words of toxic and of clean texts, and the texts."""
    found: dict[str, list[int]] = {}
    total = [0, 0, 0]
    for text, label in texts:
        side, seen = 0 if label else 1, Counter()
        for word, n in Counter(words(text)).items():
            total[side] += n
            if (of := _known.get(word)) is None:
                if len(_known) >= 200_000:
                    _known.clear()
                of = _known[word] = beginnings(word)
            for x in of:
                seen[x] += n
        total[2] += 1
        for x, n in seen.items():
            row = found.setdefault(x, [0, 0, 0])
            row[side] += n
            row[2] += n * n
    return found, total


def sure_odds(
    toxic: float, clean: float, squares: float, n_toxic: float, n_clean: float, prior: float, z: float
) -> float:
    """Token log-odds with a Dirichlet prior, moved ``z`` widened standard errors towards zero; zero if they would pass it."""
    a = prior * (toxic + clean)
    a0 = prior * (n_toxic + n_clean)
    t, c = toxic + a, clean + a
    odds = math.log(t / (n_toxic + a0 - t)) - math.log(c / (n_clean + a0 - c))
    error = math.sqrt((1 / t + 1 / c) * squares / (toxic + clean))
    return math.copysign(max(0.0, abs(odds) - z * error), odds)


def additive_scale(chance: np.ndarray, value: np.ndarray) -> float:
    """The positive solution of sum chance * exp(scale * value) = 1, by halving: it makes scores of clean words additive surprises."""
    low, high = 1e-6, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if float((chance * np.exp(np.minimum(mid * value, 600))).sum()) > 1 else (mid, high)
    return low


def calibrate(model: Model, maxima: list[float]) -> None:
    """Fit the Gumbel distribution of clean texts' best segments to their quartiles, so that mislabelled texts do not widen it."""
    if len(maxima) > 1 and np.std(maxima) > 0:
        mid = np.quantile(maxima, [0.25, 0.5, 0.75])
        model.spread = float(max(0.2, (mid[2] - mid[0]) / (math.log(math.log(4)) - math.log(math.log(4 / 3)))))
        model.place = float(mid[1] + model.spread * math.log(math.log(2)))


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic",
    max_rows: int = 20_000, prior: float = 0.05, z: float = 2.0, drift: float = 0.15, significance: float = 3.0
) -> Model:
    """Learn from at most ``max_rows`` labelled rows that are not held out, a documented bound; of their beginnings all with sure odds have a score.

    ``prior`` is the Dirichlet prior's weight as a share of the training tokens, spread over beginnings as in all training documents.
    """
    chosen = training_rows(docs, labels, label, id_col=id_col, text_col=text_col, max_rows=max_rows)
    rows = written(chosen.dropDuplicates(["text", "label"]), "distinct-training")

    @freeing(_forget_words)
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, total = count_beginnings(
                zip(texts_of(batch.column("text")).to_pylist(), batch.column("label").to_pylist())
            )
            cols = [[row[k] for row in found.values()] + [total[k]] for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([*found, None], pa.string()), *(pa.array(c, pa.int64()) for c in cols)],
                ["word", "toxic", "clean", "squares"]
            )

    counted = written(
        rows.mapInArrow(counts, "word string, toxic long, clean long, squares long").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("toxic", "clean", "squares"))),
        "beginnings"
    )
    total = counted.where("word IS NULL").first()
    n_toxic, n_clean = (total["toxic"], total["clean"]) if total else (0, 0)
    model = Model(drift=drift, significance=significance)
    if not n_toxic or not n_clean:
        return model
    a = (F.col("toxic") + F.col("clean")) * prior
    t, c, a0 = F.col("toxic") + a, F.col("clean") + a, prior * (n_toxic + n_clean)
    odds = F.log(t / (n_toxic + a0 - t)) - F.log(c / (n_clean + a0 - c))
    error = F.sqrt((1 / t + 1 / c) * F.col("squares") / (F.col("toxic") + F.col("clean")))
    # what every word begins with has no odds
    is_sure = F.when(
        F.col("word").isNotNull() & (F.col("toxic") + F.col("clean") < n_toxic + n_clean), F.abs(odds) > z * error
    )
    # beginnings of a bounded sample's words, and of these the sure ones
    for r in counted.where(is_sure).orderBy("word").collect():
        if sure := sure_odds(r["toxic"], r["clean"], r["squares"], n_toxic, n_clean, prior, z):
            model.scores[r["word"]] = sure

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each clean text: its best segment, its length, and how often its words take each value."""
        for batch in batches:
            out = [segment_and_values(model, text) for text in texts_of(batch.column("text")).to_pylist()]
            kind = pa.list_(pa.struct([("value", pa.float64()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], kind)],
                ["best", "n", "taken"]
            )

    clean = written(
        rows.where("label = 0").mapInArrow(best, "best double, n long, taken array<struct<value:double,n:long>>"),
        "clean"
    )
    taken = clean.select(F.inline("taken")).groupBy("value").agg(F.sum("n").alias("n")).orderBy("value").collect()
    chance = np.array([r["n"] for r in taken], np.float64)
    model.scale = additive_scale(chance / chance.sum(), np.array([r["value"] for r in taken])) if taken else 1.0
    # at most max_rows rows
    calibrate(
        model,
        [model.scale * r["best"] - math.log(max(1, r["n"])) for r in clean.where("best IS NOT NULL").select("best", "n").collect()]
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([model.passages(t)[1] for t in texts_of(batch.column("text")).to_pylist()], pa.list_(pa.float64())), batch.column("label")],
                ["x", "label"]
            )

    learnt = sorted((r["x"], r["label"] > 0) for r in rows.mapInArrow(features, "x array<double>, label int").collect())
    model.curve = tuple(_logistic(np.array([x for x, _ in learnt]), np.array([float(y) for _, y in learnt])))
    return model


def segment_and_values(model: Model, text: bytes | None) -> tuple[float | None, int, list[dict[str, float]]]:
    """The best segment's score, the number of words, and how many words take each value."""
    tokens = words(text)
    taken = Counter(map(model.values.__getitem__, tokens))
    return max(
        (s for *_, s in model.segments(tokens)), default=None
    ), len(tokens), [{"value": v, "n": n} for v, n in taken.items()]


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score, passages): passages are word spans (end exclusive) with their surprise."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("surprise", pa.float64())]))
        for batch in pieces(batches, "__text"):
            found = [model.passages(t) for t in texts_of(batch.column("__text")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), pa.array([model.score(x) for _, x in found], pa.float64()), pa.array([[dict(zip(("start", "end", "surprise"), p)) for p in ps] for ps, _ in found], kind)],
                [id_col, "score", "passages"]
            )

    passage = T.ArrayType(
        T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("surprise", T.DoubleType())])
    )
    out = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("passages", passage)]
    )
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, out)


def drop_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents, all their columns, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            yield batch.filter(
                pa.array([shared.value.score(shared.value.passages(t)[1]) < threshold for t in texts_of(batch.column(text_col)).to_pylist()], pa.bool_())
            )

    return docs.mapInArrow(keep, docs.schema)
