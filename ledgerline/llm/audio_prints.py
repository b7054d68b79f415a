"""Chroma audio fingerprints of a media column, and the groups of recordings that align.

A recording's spectrum is folded into twelve pitch classes per frame. Sixteen
filters, sums over rectangles of an integral image of these frames, compare
neighbouring areas; each gives two Gray-coded bits, so every position becomes a
packed 32-bit integer. Two recordings are aligned by the histogram of offsets at
which they share integers; they are linked if the bit errors at one of the best
offsets are few over a long enough overlap.

Runs of one integer (as in silence) count once, at their end. An integer that two
recordings share is a vote for the offset at which it lies in both; votes are made
by a join, added up to a histogram of offsets for each pair, and only pairs with
votes have their fingerprints fetched, once, to count the wrong bits at their
offsets. Recordings with equal fingerprints stand for each other. Integers of more
than ``HOT`` places, as in a third of a corpus that is one song with changes, would
make too many votes: their holders are compared in tasks, where most join the group
of the first, and integers of more than ``SHARD_PRINTS`` places are split so that
any two holders still meet. A place makes ``HOT`` votes at most, whatever the number
of recordings.

Defined results: null, undecodable, silent and too short media have no integers
and are in a group of their own; rows with one id are one recording, and a null
id has a fingerprint but no group. Ids are whole numbers. Recordings count whole
at any length; an empty table gives an empty result; columns beside id and media are
not read, whatever their names.
"""

from __future__ import annotations

import io
import wave
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import smallest_reachable
from .shards import split_hot, whole_shards
from .simhash import Groups
from .storage import written

SPAN = 16  # frames under one integer
HOT = 64  # places of an integer up to which all its pairs are votes
SHARD_PRINTS = 2000  # places of an integer before it is split
# one filter for each kind of comparison and place: (kind, first pitch class, classes, frames)
FILTERS = tuple(
    (kind, (3 * i + 2 * kind) % 12, (4, 6, 8, 12)[(i + kind) % 4], (4, 8, 12, 16)[i]) for kind in range(4) for i in range(4)
)
STEPS = (-0.35, 0.0, 0.35)


def wav_samples(media: bytes | None) -> tuple[int, np.ndarray]:
    """Rate and mono samples of 16-bit PCM WAV bytes; nothing if they cannot be read."""
    try:
        with wave.open(io.BytesIO(media or b"")) as f:
            if f.getsampwidth() != 2:
                return 1, np.zeros(0, np.float32)
            data = np.frombuffer(f.readframes(f.getnframes()), "<i2")
            return f.getframerate(), data[
                : len(data) // f.getnchannels() * f.getnchannels()
            ].reshape(-1, f.getnchannels()).mean(axis=1).astype(np.float32)
    except (wave.Error, EOFError):
        return 1, np.zeros(0, np.float32)


def chroma(
    rate: int, samples: np.ndarray, seconds: float = 0.256, hops: int = 4, low: float = 100.0, high: float = 1800.0
) -> np.ndarray:
    """Energy of the twelve pitch classes in each frame, scaled to length one; silent frames are zero."""
    size = int(rate * seconds)
    hop = size // hops
    if size < 16 or len(samples) < size:
        return np.zeros((0, 12), np.float32)
    bins = np.fft.rfftfreq(size, 1 / rate)
    fold = np.zeros((len(bins), 12), np.float32)
    use = np.flatnonzero((bins >= low) & (bins <= min(high, rate / 2)))
    fold[use, np.round(12 * np.log2(bins[use] / 440)).astype(int) % 12] = 1
    frames = np.lib.stride_tricks.sliding_window_view(samples, size)[::hop]
    window = np.hanning(size).astype(np.float32)
    out = np.concatenate(
        [np.square(np.abs(np.fft.rfft(frames[i : i + 256] * window, axis=1))).astype(np.float32) @ fold for i in range(0, len(frames), 256)]
    )
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-3, out / np.maximum(norm, 1e-9), 0)


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """The packed integer at each position of ``SPAN`` frames."""
    n = len(frames) - SPAN + 1
    if n <= 0 or not frames.any():
        return np.zeros(0, np.uint32)
    # the twelve classes twice, so that rectangles may wrap round the octave
    image = np.zeros((len(frames) + 1, 25))
    image[1:, 1:] = np.cumsum(np.cumsum(np.concatenate([frames, frames], axis=1), axis=0), axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return image[at + t1, c1] - image[at + t0, c1] - image[at + t1, c0] + image[at + t0, c0]

    out = np.zeros(n, np.uint32)
    for kind, first, classes, width in FILTERS:
        whole = area(0, width, first, first + classes)
        if kind == 0:  # the area against all else
            a, b = whole * 12 / classes, area(0, width, 0, 12)
        elif kind == 1:  # upper half of the classes
            a = area(0, width, first, first + classes // 2)
            b = whole - a
        elif kind == 2:  # first half of the time
            a = area(0, width // 2, first, first + classes)
            b = whole - a
        else:  # two opposite quarters
            a = area(0, width // 2, first, first + classes // 2) + area(
                width // 2, width, first + classes // 2, first + classes
            )
            b = whole - a
        level = np.searchsorted(STEPS, np.log((1e-3 + a) / (1e-3 + b)))
        out = (out << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)
    return out


def agreement(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int, float]:
    """Where b begins at ``offset`` of a: the integers under both, those that are equal, and the share of wrong bits."""
    x, y = a[max(0, offset) :], b[max(0, -offset) :]
    n = max(0, min(len(x), len(y)))
    wrong = x[:n] ^ y[:n]
    return n, int(n - np.count_nonzero(wrong)), int(np.bitwise_count(wrong).sum(dtype=np.int64)) / max(1, 32 * n)


def aligned_at(a: np.ndarray, b: np.ndarray, offset: int, most_errors: float, least_overlap: int) -> bool:
    n, votes, errors = agreement(a, b, offset)
    return votes > 0 and n >= min(least_overlap, len(a), len(b)) and errors <= most_errors


def _runs(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The integer of each run and the position where it ends."""
    last = np.flatnonzero(np.append(prints[1:] != prints[:-1], True)) if len(prints) else np.zeros(0, np.int64)
    return prints[last], last


def histogram(a: np.ndarray, b: np.ndarray) -> list[int]:
    """The offsets of b in a that have votes, those with most first."""
    (x, at), (y, there) = _runs(a), _runs(b)
    held: dict[int, list[int]] = {}
    for k, p in zip(y.tolist(), there.tolist()):
        held.setdefault(k, []).append(p)
    votes = Counter(p - q for k, p in zip(x.tolist(), at.tolist()) for q in held.get(k, ()))
    return [offset for offset, _ in sorted(votes.items(), key=lambda v: (-v[1], v[0]))]


def align(a: np.ndarray, b: np.ndarray, *, most_errors: float, least_overlap: int) -> tuple[int, float] | None:
    """The offset of b in a and the share of wrong bits, at the offset with the most votes of those that are good enough."""
    for offset in histogram(a, b):
        if aligned_at(a, b, offset, most_errors, least_overlap):
            return offset, agreement(a, b, offset)[2]
    return None


def fingerprints(media: DataFrame, *, id_col: str, media_col: str, decode: Callable = wav_samples) -> DataFrame:
    """Rows (id, prints, marks, places): packed integers as little-endian bytes, and the integers of runs and where these end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                prints = [fingerprint(chroma(*decode(m))) for m in part.column(1).to_pylist()]
                marks = [_runs(p) for p in prints]
                cols = [
                    pa.array([p.astype("<u4").tobytes() for p in prints], pa.binary()),
                    pa.array([m.astype(np.int64) for m, _ in marks], pa.list_(pa.int64())),
                    pa.array([w.astype(np.int32) for _, w in marks], pa.list_(pa.int32()))
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], [id_col, "prints", "marks", "places"])

    kind = T.StructType(
        [T.StructField(id_col, media.schema[id_col].dataType), T.StructField("prints", T.BinaryType()), T.StructField("marks", T.ArrayType(T.LongType())), T.StructField("places", T.ArrayType(T.IntegerType()))]
    )
    return media.select(id_col, media_col).mapInArrow(run, kind)


def aligned_groups(
    media: DataFrame, *, id_col: str, media_col: str, decode: Callable = wav_samples, most_errors: float = 0.15,
    least_overlap: int = 32
) -> DataFrame:
    """Rows (id, n_ints, prints, group_id): the smallest id reachable over recordings that align."""
    made = written(fingerprints(media, id_col=id_col, media_col=media_col, decode=decode), "prints")
    held = made.where(F.col(id_col).isNotNull() & (F.length("prints") > 0)).select(
        F.col(id_col).cast("long").alias("id"), "prints", "marks", "places", F.xxhash64("prints").alias("same"),
        F.crc32("prints").alias("check")
    )
    nodes = held.groupBy("same", "check").agg(F.min("id").alias("node"))
    equal = held.select("id", "same", "check").join(nodes, ["same", "check"]).where("id != node").select(
        F.col("id").alias("u"), F.col("node").alias("v")
    )
    # rows of one id may have several fingerprints: one row for each fingerprint, under its smallest id
    own = written(
        held.join(nodes, ["same", "check"]).where("id = node").dropDuplicates(["same", "check"]).select("node", "same", "prints", "marks", "places"),
        "recordings"
    )
    marks = own.select("node", "same", F.inline(F.arrays_zip("marks", "places"))).withColumnsRenamed({"marks": "shard", "places": "at"})
    shared = marks.groupBy("shard").agg(F.count("*").alias("n"), F.min("same").alias("a"), F.max("same").alias("b")).where("a != b")
    # rows in which two recordings may meet; most integers are one recording's alone
    met = written(marks.join(shared.select("shard", "n"), "shard"), "votes")
    few = met.where(F.col("n") <= HOT)
    left = few.select("shard", F.col("node").alias("a"), F.col("at").alias("x"))
    right = few.select("shard", F.col("node").alias("b"), F.col("at").alias("y"))
    votes = left.join(right, "shard").where("a < b").groupBy("a", "b", (F.col("x") - F.col("y")).alias("offset")).agg(F.count("*").alias("n"))
    peaks = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "offset")))
    pairs = votes.groupBy("a", "b").agg(peaks.alias("peaks")).select("a", "b", F.col("peaks.offset").alias("offsets"))
    prints = own.select("node", "prints")
    fetched = pairs.join(prints.withColumnsRenamed({"node": "a", "prints": "p"}), "a").join(prints.withColumnsRenamed({"node": "b", "prints": "q"}), "b")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = ([np.frombuffer(x.as_buffer(), "<u4") for x in batch.column(c)] for c in ("p", "q"))
            good = [
                any(aligned_at(x, y, o, most_errors, least_overlap) for o in offsets)
                for x, y, offsets in zip(first, second, batch.column("offsets").to_pylist())
            ]
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["u", "v"])

    voted = fetched.select("a", "b", "offsets", "p", "q").mapInArrow(checked, "u long, v long")
    rows = split_hot(written(met.where(F.col("n") > HOT).drop("n"), "hot-integers"), "shard", "same", SHARD_PRINTS)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shards, table in whole_shards(batches):
            u, v = [], []
            nodes, places, values = table.column("node").to_numpy(), table.column("at").to_numpy(), table.column("prints")
            for a, b in shards:
                prints = [np.frombuffer(x.as_buffer(), "<u4") for x in values.slice(a, b - a)]
                at, groups = places[a:b], Groups(b - a)
                for i in range(1, b - a):
                    # the first of each group before all others, as most align with it
                    first = groups.root[:i] == np.arange(i)
                    for some in (np.flatnonzero(first), np.flatnonzero(~first)):
                        for j in some[groups.root[some] != groups.root[i]].tolist():
                            if groups.root[j] != groups.root[i] and aligned_at(
                                prints[i], prints[j], int(at[i] - at[j]), most_errors, least_overlap
                            ):
                                groups.join(i, np.array([j]))
                for i, j in groups.links():
                    u.append(nodes[a + i])
                    v.append(nodes[a + j])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    rows = rows.join(own.select("node", "same", "prints"), ["node", "same"]).select("shard", "node", "at", "prints")
    found = rows.repartition("shard").sortWithinPartitions("shard", "node", "at").mapInArrow(links, "u long, v long")
    groups = smallest_reachable(found.unionByName(voted).unionByName(equal))
    out = made.join(groups, F.col(id_col).cast("long") == F.col("node"), "left")
    return out.select(
        id_col, (F.length("prints") / 4).cast("long").alias("n_ints"), "prints",
        F.coalesce("component", F.col(id_col).cast("long")).alias("group_id")
    )


def played_vector(
    vector: list[float] | None, rate: int = 4000, note: int = 256, lowest: float = 220.0, notes: int = 25
) -> tuple[int, np.ndarray]:
    """A vector as a melody, one tone for each value: media for tables that have none."""
    if not vector or any(x is None for x in vector):
        return rate, np.zeros(0, np.float32)
    values = np.nan_to_num(np.array(vector, np.float64))
    scale = np.sqrt(np.square(values).mean())
    tone = np.clip(np.round((values / scale if scale else values) * notes / 5 + notes // 2), 0, notes - 1)
    pitch = lowest * 2 ** (tone / 12)
    return rate, np.sin(np.cumsum(np.repeat(2 * np.pi * pitch / rate, note))).astype(np.float32)
