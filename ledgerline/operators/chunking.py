"""Overlapping token windows over sections, and their embeddings."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts whose windows a task holds together.
AT_ONCE = 64
_WORD = re.compile(r"\S+")
_END = re.compile(r"[.!?][\"'”’)}\]]*$")


class Encoder(Protocol):
    """Something that counts the tokens of any part of a text, after one look at the whole."""

    def __call__(self, text: str) -> Callable[[int, int], int]: ...


@dataclass
class Pieces:
    """Tokens that never cross the pieces a pattern cuts a text into, as in any tokenizer with a pre-tokenizer.

    The text is cut once and the counts of its pieces summed up, each distinct piece being counted once. A part of the text
    has the sum of the pieces inside, and its first and last piece anew if the part cuts them.
    """

    pattern: str
    count: Callable[[str], int]
    most: int = 100_000

    def __post_init__(self) -> None:
        self._known: dict[str, int] = {}

    def _of(self, piece: str) -> int:
        if piece not in self._known:
            if len(self._known) >= self.most:
                self._known.clear()
            self._known[piece] = self.count(piece)
        return self._known[piece]

    def __call__(self, text: str) -> Callable[[int, int], int]:
        cut = regex.compile(self.pattern)
        spans = [m.span() for m in cut.finditer(text)]
        starts, ends = [a for a, _ in spans], [b for _, b in spans]
        sums = [0, *np.cumsum([self._of(text[a:b]) for a, b in spans], dtype=np.int64).tolist()]
        anew = lambda a, b: sum(self._of(m[0]) for m in cut.finditer(text[a:b]))

        def size(a: int, b: int) -> int:
            # the first piece that ends after a, and the first one that ends at b or after it
            first, last = bisect_right(ends, a), bisect_right(ends, b - 1)
            if first >= last and not (first < len(spans) and starts[first] >= a and ends[first] <= b):
                return anew(a, b)
            total = sums[min(last + 1, len(spans))] - sums[first]
            if starts[first] < a:
                total += anew(a, ends[first]) - (sums[first + 1] - sums[first])
            if last < len(spans) and ends[last] > b:
                total += anew(min(starts[last], b), b) - (sums[last + 1] - sums[last])
            return total

        return size


@dataclass
class Whole:
    """Any function of a text: each part is encoded anew."""

    count: Callable[[str], int]

    def __call__(self, text: str) -> Callable[[int, int], int]:
        return lambda a, b: self.count(text[a:b])


#: The default: one token a word.
WORDS = Pieces(r"\S+", lambda _: 1)


def windows(
    text: str, max_tokens: int = 700, overlap: float = 0.15, encode: Encoder | Callable[[str], int] = WORDS
) -> list[tuple[str, int]]:
    """Chunks of up to ``max_tokens`` that end at a sentence or line where that leaves at least 60 % of the budget.

    A chunk begins with the longest run of the last one's words that fits the overlap. A word over the budget stays whole.
    """
    if max_tokens <= 0 or not 0 <= overlap < 1:
        raise ValueError("max_tokens is positive and overlap a share below one")
    spare, least = min(round(max_tokens * overlap), max_tokens - 1), max(1, round(0.6 * max_tokens))
    spans = [m.span() for m in _WORD.finditer(text)]
    counted = (encode if isinstance(encode, Pieces | Whole) else Whole(encode))(text)
    size = lambda a, b: counted(spans[a][0], spans[b - 1][1]) if b > a else 0
    natural = [
        bool(_END.search(text[slice(*spans[i])])) or (i + 1 < len(spans) and "\n" in text[spans[i][1] : spans[i + 1][0]]) for i in range(len(spans))
    ]
    stops = [-1, *(i for i, n in enumerate(natural) if n)]
    out, begin = [], 0
    while begin < len(spans):
        end = _furthest(lambda e: size(begin, e) <= max_tokens, begin + 1, len(spans))  # noqa: B023
        if end < len(spans):
            # the nearest natural end decides, even when it is too early to be taken
            stop = stops[bisect_right(stops, end - 1) - 1] + 1
            if stop > begin and size(begin, stop) >= least:
                end = stop
        out.append((text[spans[begin][0] : spans[end - 1][1]], size(begin, end)))
        if end == len(spans):
            break
        low, high = begin + 1, end
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if size(mid, end) <= spare else (mid + 1, high)
        begin = low
    return out


def _furthest(fits: Callable[[int], bool], low: int, high: int) -> int:
    """The last number up to ``high`` that fits, looked for in growing steps from ``low``, which counts as fitting."""
    step = 1
    while low + step <= high and fits(low + step):
        low, step = low + step, 2 * step
    high = min(high, low + step - 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if fits(mid) else (low, mid - 1)
    return low


def chunk_sections(
    sections: DataFrame, keys: list[str], max_tokens: int = 700, overlap: float = 0.15,
    encode: Encoder | Callable[[str], int] = WORDS
) -> DataFrame:
    """Rows (keys, chunk_index, text, token_count) of (keys, text); the index begins anew in each section."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the windows of a few texts at a time, not of a whole batch of long ones
        for batch in (b.slice(at, AT_ONCE) for b in batches for at in range(0, b.num_rows, AT_ONCE)):
            found = [windows(t or "", max_tokens, overlap, encode) for t in batch.column("text").to_pylist()]
            take = pa.array([i for i, f in enumerate(found) for _ in f], pa.int32())
            flat = [(k, *c) for f in found for k, c in enumerate(f)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(take) for k in keys), pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.string()), pa.array([x[2] for x in flat], pa.int32())],
                [*keys, "chunk_index", "text", "token_count"]
            )

    kinds = ", ".join(f"{k} {sections.schema[k].dataType.simpleString()}" for k in keys)
    return sections.select(*keys, "text").mapInArrow(run, f"{kinds}, chunk_index int, text string, token_count int")


def hashed_embedding(texts: list[str], dimensions: int = 64) -> list[list[float]]:
    """A deterministic stand-in for an embedding model: signed hashed words, length one."""
    out = np.zeros((len(texts), dimensions), np.float32)
    for row, text in zip(out, texts):
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            row[h % dimensions] += 1 if h >> 63 else -1
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).tolist()


def embed(
    chunks: DataFrame, dimensions: int, model: Callable[[list[str], int], list[list[float]]] = hashed_embedding,
    batch_size: int = 100
) -> DataFrame:
    """Adds ``embedding``; the model gets at most ``batch_size`` texts at once and must return as many vectors of the right size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                vectors = model(part.column("text").to_pylist(), dimensions)
                if len(vectors) != part.num_rows or any(
                    len(v) != dimensions or not np.isfinite(v).all() for v in vectors
                ):
                    raise ValueError("the model's vectors do not fit the texts")
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(vectors, pa.list_(pa.float32()))], [*part.schema.names, "embedding"]
                )

    return chunks.mapInArrow(
        run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in chunks.schema)}, embedding array<float>"
    )
