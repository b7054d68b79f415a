"""Token counts of a subword model, summed over pre-tokens.

No piece of the model holds a space mark after another character (checked when
it is loaded), so no merge crosses the start of a run of spaces: the tokens of a
text are those of its pre-tokens, each a run of spaces and what follows. The
pieces of each distinct pre-token of the corpus are counted once; documents keep
only the frequencies of their pre-tokens. Counts of the ``hot`` most frequent
pre-tokens (a fixed bound) are broadcast and summed on the spot; all others are
joined by a shuffle on the pre-token, which rare keys cannot skew. No ids are
ever materialised.

Defined results: null and empty texts have no tokens and no bytes; each row of
the input gives one row, also repeated rows and null ids; texts count whole at any
length; an empty table gives no rows; columns beside id and text are not read,
whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import written
from .text import pieces

MARK = "▁"  # how the model writes a space
_RUNS = re.compile(" +[^ ]*")


@lru_cache(maxsize=2)
def model(path: str):
    import sentencepiece

    loaded = sentencepiece.SentencePieceProcessor(model_file=path)
    names = (loaded.id_to_piece(i) for i in range(loaded.get_piece_size()))
    if any(re.search(f"[^{MARK}]{MARK}", x) for x in names):
        raise ValueError(f"{path}: a piece crosses a space, so pre-tokens cannot be counted apart")
    return loaded


def pretokens(text: str) -> list[str]:
    """A text's pre-tokens; the library puts one space before a text that is not empty."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [x[1:] for x in _RUNS.findall(f" {text}")]
    return text.split(" ")


def count_pieces(words: list[str], path: str) -> np.ndarray:
    """Pieces of each pre-token; an empty one is a single space mark."""
    encoded = model(path).encode(words, num_threads=1)
    return np.fromiter((len(x) if w else 1 for w, x in zip(words, encoded)), np.int64, len(words))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frequencies of pre-tokens, summed over as many documents as a bounded table holds."""
    seen: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pretoken", "freq"]
        )
        seen.clear()
        return done

    for batch in pieces(batches, "__text"):
        for text in batch.column("__text").to_pylist():
            seen.update(pretokens(text or ""))
        if len(seen) > 400_000:
            yield out()
    yield out()


def pretoken_counts(docs: DataFrame, path: str, *, text_col: str = "text") -> DataFrame:
    """Each distinct pre-token of the documents: (pretoken, freq, pieces)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(count_pieces(words, path))], ["pretoken", "freq", "pieces"]
            )

    distinct = docs.select(F.col(text_col).alias("__text")).mapInArrow(
        _partial, "pretoken string, freq long"
    ).groupBy("pretoken").agg(F.sum("freq").alias("freq"))
    return distinct.mapInArrow(counted, "pretoken string, freq long, pieces long")


def _most_frequent(table: DataFrame, most: int) -> DataFrame:
    """(pretoken, pieces) of at most ``most`` rows: all above a frequency, found from a histogram, so that no task sorts the whole table."""
    step = F.floor(F.log2("freq") * 8)
    taken, lowest = 0, None
    for at, n in sorted(table.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if taken + n > most:
            break
        taken, lowest = taken + n, at
    chosen = table.where(step >= lowest) if lowest is not None else table.limit(0)
    return chosen.select("pretoken", "pieces")


def count_tokens(
    docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", hot: int = 250_000
) -> DataFrame:
    """Rows (id, n_bytes, n_tokens)."""
    spark = docs.sparkSession
    table = written(pretoken_counts(docs, path, text_col=text_col), "pretokens")
    frequent = _most_frequent(table, hot).toArrow()
    known = spark.sparkContext.broadcast(dict(zip(*(c.to_pylist() for c in frequent.columns))))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with its id, bytes and frequent tokens, and one for each of its rare pre-tokens."""
        sums, row = known.value, TaskContext.get().partitionId() << 40
        for batch in pieces(batches, "__text"):
            first, at, words, freqs, sizes = row, [], [], [], []
            for text in batch.column("__text").to_pylist():
                total = 0
                for word, n in Counter(pretokens(text or "")).items():
                    if (k := sums.get(word)) is not None:
                        total += k * n
                    else:
                        at.append(row)
                        words.append(word)
                        freqs.append(n)
                at.append(row)
                words.append(f"{MARK}{row}")  # no pre-token holds the mark: joins nothing and is dealt evenly
                freqs.append(total)
                sizes.append((len(at) - 1, len((text or "").encode())))
                row += 1
            owner = np.full(len(at), -1)
            size = np.full(len(at), -1)
            where = np.array([x for x, _ in sizes])
            owner[where], size[where] = np.arange(row - first), [x for _, x in sizes]
            none = owner < 0
            ids = batch.column("__id").take(pa.array(owner, mask=none))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(at), pa.array(words, pa.string()), pa.array(freqs, pa.int64()), pa.array(size, mask=none)],
                kind.names
            )

    kind = T.StructType(
        [T.StructField("__id", docs.schema[id_col].dataType)] + [T.StructField(n, t()) for n, t in (("__row", T.LongType), ("pretoken", T.StringType), ("freq", T.LongType), ("bytes", T.LongType))]
    )
    parts = rows.mapInArrow(rare, kind).join(table.select("pretoken", "pieces"), "pretoken", "left")
    sums = parts.groupBy("__row").agg(
        F.max("__id").alias(id_col), F.max("bytes").alias("n_bytes"),
        F.sum(F.col("freq") * F.coalesce("pieces", F.lit(1))).alias("n_tokens")
    )
    return sums.select(id_col, "n_bytes", "n_tokens")
