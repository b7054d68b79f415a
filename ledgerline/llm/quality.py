"""Quality by nearest-neighbour voting in a latent semantic space.

A text's terms are the pairs of neighbouring byte classes (letters, capitals,
digits, each punctuation mark, white space, other bytes) and how often its words
repeat; their log frequencies, weighted by rarity and scaled to length one, are
projected onto the leading singular vectors of a bounded sample of labelled
texts. The sample's vectors are broadcast; each document's exact cosines with
all of them are computed in blocks, and the labels of the nearest vote with
their similarity as weight.

Defined results: null and empty texts have a zero vector and get the share of
label 1 in the sample; so has every text if nothing is labelled (then 0.5). Each
row gives one row, also repeated rows and null ids; equal texts score equally, and
of neighbours that tie all vote with their similarity; texts count whole at any
length; an empty table gives no rows; columns beside id and text are not read,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import training_rows
from .text import pieces, texts_of

_LETTERS = {b: b - 97 for b in range(97, 123)}
_MARKS = {b: 30 + i for i, b in enumerate(b for b in range(33, 127) if not chr(b).isalnum())}


def _class(b: int) -> int:
    if b in _LETTERS or b in _MARKS:
        return (_LETTERS | _MARKS)[b]
    return 26 if 65 <= b <= 90 else 27 if 48 <= b <= 57 else 28 if b == 32 else 29 if b < 33 else 62 if b < 0xC4 else 63


_CLASSES = np.array([_class(b) for b in range(256)], np.uint16)
_PAIRS, _STEPS = 64 * 64, 12
TERMS = _PAIRS + _STEPS


def terms(text: bytes | None) -> np.ndarray:
    """Frequencies of a text's terms."""
    out = np.zeros(TERMS, np.float32)
    if text:
        codes = _CLASSES[np.frombuffer(text, np.uint8)]
        out[:_PAIRS] = np.bincount(codes[:-1] * np.uint16(64) + codes[1:], minlength=_PAIRS)
        words = text.split()
        if len(words) > 1:
            # words as a power of distinct words: near one in prose, small in repetition
            variety = math.log(len(set(words))) / math.log(len(words))
            out[_PAIRS + min(_STEPS - 1, int(variety * _STEPS))] = 1 + len(words)
    return out


@dataclass
class Space:
    """Term weights, projection, and the labelled vectors with their labels."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    power: float

    @property
    def share(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.weights
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def project(self, counts: np.ndarray) -> np.ndarray:
        x = self.weighted(counts) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def votes(self, counts: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest of one block of texts."""
        if not len(self.labels):
            return np.full(len(counts), self.share)
        near = self.project(counts) @ self.vectors.T
        k = min(self.neighbours, len(self.labels))
        top = np.argpartition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k :]
        weight = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** self.power
        total = weight.sum(axis=1)
        return np.where(total > 0, (weight * self.labels[top]).sum(axis=1) / np.maximum(total, 1e-12), self.share)


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "quality",
    max_rows: int = 6000, dimensions: int = 64, neighbours: int = 15, power: float = 4.0,
    repetition_weight: float = 3.0, seed: int = 2
) -> Space:
    """The space of at most ``max_rows`` labelled rows that are not held out: a fixed bound on what is collected and broadcast."""
    rows = training_rows(docs, labels, label, id_col=id_col, text_col=text_col, max_rows=max_rows)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = [terms(t) for t in texts_of(batch.column("text")).to_pylist()]
            some = [np.flatnonzero(x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s.astype(np.int16) for s in some], pa.list_(pa.int16())), pa.array([x[s] for x, s in zip(found, some)], pa.list_(pa.float32())), batch.column("label")],
                ["at", "n", "label"]
            )

    sample = rows.mapInArrow(counted, "at array<short>, n array<float>, label int").toArrow()
    y = sample.column("label").to_numpy().astype(np.float64).clip(0, 1)
    x = np.zeros((len(y), TERMS), np.float32)
    for i, (at, n) in enumerate(zip(sample.column("at"), sample.column("n"))):
        x[i, at.values.to_numpy()] = n.values.to_numpy()
    weights = np.log((1 + len(y)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    weights[_PAIRS:] *= repetition_weight
    space = Space(
        weights, np.zeros((TERMS, dimensions), np.float32), np.zeros((0, dimensions), np.float32), y, neighbours, power
    )
    if len(y):
        w = space.weighted(x)
        del x
        # randomised singular value decomposition with a fixed seed
        basis = w @ np.random.default_rng(seed).standard_normal((TERMS, dimensions + 16), np.float32)
        for _ in range(3):
            basis = w @ (w.T @ np.linalg.qr(basis)[0])
        _, _, axes = np.linalg.svd(np.linalg.qr(basis)[0].T @ w, full_matrices=False)
        found = np.zeros((TERMS, dimensions), np.float32)
        found[:, : min(dimensions, len(axes))] = axes[:dimensions].T
        space.axes = found
        vectors = w @ found
        space.vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return space


def score(
    docs: DataFrame, space: Space, *, id_col: str = "doc_id", text_col: str = "text", block: int = 128
) -> DataFrame:
    """Rows (id, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text"):
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                counts = np.stack([terms(t) for t in texts_of(part.column("__text")).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("__id"), pa.array(shared.value.votes(counts).clip(0, 1))], [id_col, "score"]
                )

    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, out)
