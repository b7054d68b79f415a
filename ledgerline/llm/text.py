"""Words, hashes and Arrow plumbing that the corpus operators share.

Texts travel as UTF-8 bytes: ``bytes.split()`` cuts at exactly the six ASCII
white-space bytes and ``bytes.lower()`` lowers exactly A-Z.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


class WordHashes(dict):
    """Word -> 64-bit hash, remembered for at most ``cap`` words."""

    def __init__(self, seed: int = 0, cap: int = 400_000):
        super().__init__()
        self.seed, self.cap = seed, cap

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.cap:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        factors = np.empty((2, max(n, 1 << 20)), np.uint64)
        factors[0], factors[1], factors[:, 0] = _BASE, _BASE_INV, 1
        _powers[:] = [np.cumprod(x, dtype=np.uint64) for x in factors]
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xCA5A826395121157)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Hashes of any run of words of one array, from one prefix sum."""

    def __init__(self, words: np.ndarray):
        up, down = powers(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=self.sums[1:])
        self.down = down

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        n = max(0, len(self.sums) - k)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n] + np.uint64(k))


def freeing(free: Callable[[], None]) -> Callable:
    """A decorator for Arrow stages: ``free``, a function of a module, empties the worker's caches when a task ends, so that none is carried into another stage."""

    def wrap(stage: Callable) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            try:
                yield from stage(batches)
            finally:
                free()
                pa.default_memory_pool().release_unused()

        return run

    return wrap


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column as binary, without copying its bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def pieces(batches: Iterable[pa.RecordBatch], text: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about ``limit`` bytes of text, one document at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = texts_of(batch.column(text))
        lengths = np.diff(
            np.frombuffer(size.buffers()[1], np.int64 if pa.types.is_large_binary(size.type) else np.int32, len(size) + 1, size.offset * (8 if pa.types.is_large_binary(size.type) else 4))
        )
        block = np.cumsum(lengths.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def concat(lists: Iterable[list]) -> tuple[list, np.ndarray]:
    """All lists in one, and where each begins (one more entry than lists)."""
    flat: list = []
    begins = [0]
    for x in lists:
        flat += x
        begins.append(len(flat))
    return flat, np.array(begins, np.int64)
