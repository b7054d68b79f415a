"""Source divergence: how far sources of a language use its words differently.

Words are counted for each language and source, in tasks first and then over all
documents. Of each language the terms that enough of its documents hold are kept
and dealt to blocks; a block is a dense matrix of sources by terms. For each block
(and, where a language has many sources, for each pair of blocks of sources) one
task compares all pairs of rows at once in 64-bit integers. The partial sums of
pairs are added up, the best terms of each source's blocks are merged.

With count occurrences of a term in a source, N of all kept terms there and V kept
terms, p = 1 + floor(10**9 (count + 2) / (N + 2 V)), exactly. The language's own q is
made of its whole counts in the same way. Two rows differ at a term by
floor((p - q)**2 / (p + q)).

Defined results: null texts, languages and sources are empty ones; every source
with a document is compared, also without terms; repeated documents and ids count
each; a language without kept terms has pairs of value 0 and no terms; equal values
rank by the item's UTF-8 bytes; texts count whole; an empty table gives no rows;
columns beside the named ones are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written
from .text import pieces, texts_of

#: Terms and sources of a block, and distinct words that a task counts before it passes them on.
TERMS, SOURCES, HELD = 1024, 64, 400_000

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and all characters beyond ASCII; A-Z lowered."""
    return text.translate(_LETTERS).split()


def _counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, term, times, docs), with an empty term for each source; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[tuple, Counter] = {}
        held: dict[tuple, Counter] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in times.items():
                names = [b"", *found]
                n = len(names)
                within = held[lang, source]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(names, pa.binary()).cast(pa.string()),
                        pa.array([0, *found.values()], pa.int64()), pa.array([0, *(within[t] for t in found)], pa.int64()),
                    ], ["lang", "source", "term", "times", "docs"],
                )
            times.clear()
            held.clear()

        for batch in pieces(batches, "text"):
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts_of(batch.column("text"))):
                words = terms(text.as_py())
                times.setdefault((lang, source), Counter()).update(words)
                held.setdefault((lang, source), Counter()).update(set(words))
            if sum(map(len, times.values())) > HELD:
                yield from passed_on()
        yield from passed_on()

    rows = docs.mapInArrow(run, "lang string, source string, term string, times long, docs long")
    return written(rows.groupBy("lang", "source", "term").agg(F.sum("times").alias("times"), F.sum("docs").alias("docs")), "word-counts")


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 (counts + 2) / whole) digit by digit, so that nothing leaves 64 bits below 9 * 10**17 words."""
    rest, out = counts + 2, np.zeros(counts.shape, np.int64)
    for _ in range(9):
        rest = rest * 10
        out = out * 10 + rest // whole
        rest = rest % whole
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _tile(table: pa.Table, top: int, size: int) -> pa.Table:
    """Partial pair values of two blocks of sources over one block of terms; where the blocks are the same, the best terms too. Blocks have ``size`` sources."""
    rows = table.select(["gid", "source", "n", "n_terms", "terms", "times"]).to_pylist()
    whole = next((r for r in rows if r["gid"] < 0), None)
    names = sorted(whole["terms"]) if whole else []
    number = {t: k for k, t in enumerate(names)}

    def matrix(some: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros((len(some), len(names)), np.int64)
        for k, r in enumerate(some):
            counts[k, [number[t] for t in r["terms"]]] = r["times"]
        sums = np.array([[r["n"] + 2 * r["n_terms"]] for r in some], np.int64).reshape(-1, 1)
        return counts, shares(counts, sums)

    a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
    groups = sorted((r for r in rows if r["gid"] >= 0), key=lambda r: r["gid"])
    ours, theirs = ([r for r in groups if r["gid"] // size == x] for x in (a, b))
    counts, p = matrix(ours)
    _, q = (counts, p) if a == b else matrix(theirs)
    found: list[tuple] = []
    for k, r in enumerate(ours):
        values = distance(p[k], q).sum(axis=1)
        for other, value in zip(theirs, values.tolist()):
            if other["gid"] > r["gid"]:
                found += [(r["source"], "pair", other["source"], value), (other["source"], "pair", r["source"], value)]
    if a == b and whole:
        _, base = matrix([whole])
        apart = distance(p, base)
        for k, r in enumerate(ours):
            more = np.flatnonzero((counts[k] > 0) & (p[k] > base[0]))
            best = more[np.lexsort((more, -apart[k, more]))][:top]
            found += [(r["source"], "term", names[t], int(apart[k, t])) for t in best]
    columns = [list(c) for c in zip(*found)] if found else [[], [], [], []]
    lang = pa.array([table.column("lang")[0].as_py()] * len(found), pa.string())
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.table([lang, *(pa.array(c, k) for c, k in zip(columns, kinds))], ["lang", "source", "part", "item", "value"])


def audit(
    docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 10, top: int = 10
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part ``pair`` has all other sources of the language, ``term`` the ``top`` terms."""
    named = {"lang": lang_col, "source": source_col, "text": text_col}
    counts = _counts(docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in named.items()]))
    words = counts.where("term <> ''")
    kept = words.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("times").alias("times"))
    kept = written(kept.where(F.col("docs") >= least_docs).select("lang", "term", "times"), "kept-terms")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("times").alias("n"))
    of_groups = written(words.select("lang", "source", "term", "times").join(kept.select("lang", "term"), ["lang", "term"]), "kept-counts")

    # sources by number; a language's row of all its sources has the number -1
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    sources = counts.where("term = ''").select("lang", "source").withColumn("gid", number.cast("long"))
    sums = of_groups.groupBy("lang", "source").agg(F.sum("times").alias("n"))
    langs = sources.groupBy("lang").agg(F.count("*").alias("n_sources")).join(sizes.withColumnRenamed("n", "n_lang"), "lang", "left")
    blocks = F.greatest(F.lit(1), F.ceil(F.coalesce("n_terms", F.lit(0)) / TERMS)).cast("long")
    langs = written(langs.select("lang", F.ceil(F.col("n_sources") / SOURCES).cast("long").alias("n_groups"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.coalesce("n_lang", F.lit(0)).alias("n_lang"), blocks.alias("n_blocks")), "languages")
    block = F.pmod(F.xxhash64("term"), F.col("n_blocks")).alias("block")
    pairs = F.collect_list(F.struct("term", "times")).alias("pairs")
    known = langs.select("lang", "n_blocks")
    lists = of_groups.join(known, "lang").select("lang", "source", block, "term", "times").groupBy("lang", "source", "block").agg(pairs)
    whole = kept.join(known, "lang").select("lang", block, "term", "times").groupBy("lang", "block").agg(pairs)

    cells = sources.join(sums, ["lang", "source"], "left").join(langs, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    cells = cells.join(lists, ["lang", "source", "block"], "left").select("*", (F.col("gid") / SOURCES).cast("long").alias("g"))
    cells = cells.withColumn("h", F.explode(F.sequence(F.lit(0), F.col("n_groups") - 1)))
    wide = ("lang", "block", F.least("g", "h").alias("a"), F.greatest("g", "h").alias("b"), "gid", "source", F.coalesce("n", F.lit(0)).alias("n"), "n_terms", "pairs")
    bases = whole.join(langs, "lang").withColumn("g", F.explode(F.sequence(F.lit(0), F.col("n_groups") - 1)))
    bases = bases.withColumn("h", F.explode(F.sequence("g", F.col("n_groups") - 1)))
    bases = bases.select("lang", "block", F.col("g").alias("a"), F.col("h").alias("b"), F.lit(-1).cast("long").alias("gid"), F.lit("").alias("source"), F.col("n_lang").alias("n"), "n_terms", "pairs")
    empty = F.array().cast("array<struct<term:string,times:bigint>>")
    rows = cells.select(*wide).unionByName(bases).withColumn("pairs", F.coalesce("pairs", empty))
    rows = rows.select("lang", "block", "a", "b", "gid", "source", "n", "n_terms", F.col("pairs.term").alias("terms"), F.col("pairs.times").alias("times"))

    size = SOURCES

    def run(table: pa.Table) -> pa.Table:
        return _tile(table, top, size)

    found = rows.groupBy("lang", "block", "a", "b").applyInArrow(run, "lang string, source string, part string, item string, value long")
    # a term lies in one block, a pair in all: both add up
    total = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = total.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
