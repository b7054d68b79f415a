"""A persisted positional index of passages, and ranked searches that read only what they ask for.

A posting row belongs to a term and a block of passages: the passages' ids, how
often each holds the term and at which places, and the most that one of them holds
it. Rows are partitioned by a bucket of the term and sorted by it, so a search
opens the buckets of its terms and, by the statistics of Parquet, their row groups.
New passages come as new blocks, committed to the index's log.

Ranks are cover densities: a cover is a shortest run of words that answers the
question; it counts 0.1, divided by one more than the words in it that were not
asked for. Three kinds of question:

* ``any``: passages with any of the terms. Each place is a cover of its own.
* ``all``: passages with all terms, more for terms that stand close together.
* ``phrase``: passages where the words follow one another as asked, stop words between them taken as gaps.

Block-max pruning: the sum of a block's highest counts bounds the score of its
passages. Each question visits its best blocks, and after that only blocks whose
bound reaches the k-th best score found there. Results are those of a full search.

Questions without terms, passages without text and null ids find and are nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.stemming import ENGLISH_STOP_WORDS, stem, stems
from ..session import stored
from ..sources import commits
from .retrieval import Search, checked_k, metadata_predicate, top_k

#: Passages of a block, buckets of terms, and parts that each bucket is written in, at least.
BLOCK, BUCKETS, PARTS = 1024, 64, 4
#: Blocks of questions that a task scores on average, whatever the size of the index.
VISITS = 256
#: Up to so many distinct terms of a set of questions are pushed into the scan; beyond, they are joined.
MOST_TERMS = 2000
#: Blocks that a question visits before it has a bound.
FIRST = 2
COVER = 0.1
SCHEMA = "term string, block long, best int, ids array<long>, counts array<int>, places array<array<int>>, bucket int"
MODES = ("any", "all", "phrase")


def _stop_words(english: bool) -> list[str]:
    return list(ENGLISH_STOP_WORDS if english else X.STOP_WORDS)


def _words(column: str) -> Column:
    """All words in order, stop words too: their places count."""
    return F.regexp_extract_all(F.lower(F.col(column)), F.lit(r"[a-z0-9]+"), F.lit(0))


def _bucket(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int").alias("bucket")


def _block(ids: np.ndarray, words: pa.Array, english: bool) -> pa.RecordBatch:
    """The posting rows of some passages, by array passes; each distinct word is stemmed once."""
    size = pc.fill_null(pc.list_value_length(words), 0).to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    kept = pc.invert(pc.is_in(words.flatten(), value_set=pa.array(_stop_words(english)))).to_numpy(zero_copy_only=False)
    known = pc.dictionary_encode(words.flatten().filter(pa.array(kept)))
    code, row, place, names = known.indices.to_numpy(), row[kept], place[kept], known.dictionary
    if english and len(names):
        found, stem_of = np.unique([stem(w) for w in names.to_pylist()], return_inverse=True)
        code, names = stem_of[code], pa.array(found.tolist(), pa.string())
    by = np.argsort(code, kind="stable")
    code, row, place = code[by], row[by], place[by].astype(np.int32)
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    pair = np.flatnonzero(new)
    counts = np.diff(np.append(pair, len(code)))
    first = np.ones(len(pair), bool)
    first[1:] = code[pair][1:] != code[pair][:-1]
    begin = np.flatnonzero(first)
    offsets = pa.array(np.append(begin, len(pair)).astype(np.int32))
    best = np.maximum.reduceat(counts, begin) if len(begin) else np.zeros(0, np.int64)
    inner = pa.ListArray.from_arrays(pa.array(np.append(pair, len(code)).astype(np.int32)), pa.array(place))
    return pa.RecordBatch.from_arrays(
        [
            names.take(pa.array(code[pair][begin])), pa.array(np.full(len(begin), ids.min() if len(ids) else 0)), pa.array(best.astype(np.int32)),
            pa.ListArray.from_arrays(offsets, pa.array(ids[row[pair]])), pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32))),
            pa.ListArray.from_arrays(offsets, inner),
        ], ["term", "block", "best", "ids", "counts", "places"],
    )


def postings(chunks: DataFrame, *, english: bool = True) -> DataFrame:
    """Posting rows of passages (id, text); ids are distinct. A block is named by its smallest id."""
    rows = chunks.where("id IS NOT NULL AND text IS NOT NULL").select(F.col("id").cast("long").alias("id"), _words("text").alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                yield _block(part.column("id").to_numpy(), part.column("words"), english)

    return rows.mapInArrow(run, SCHEMA.rpartition(", bucket")[0]).withColumn("bucket", _bucket("term"))


@dataclass(frozen=True)
class TextIndex:
    """An index at rest. ``english``: terms are stems of English words without its stop words, else plain words without a few.

    Questions are treated like passages.
    """

    path: str
    english: bool = True

    def add(self, chunks: DataFrame) -> int:
        """Commits the postings of passages that are not in the index; returns the version."""
        # a term that is everywhere has rows in all blocks: each bucket is written by several tasks, and by more as it grows
        rows = postings(chunks, english=self.english).withColumn("part", F.pmod(F.xxhash64("block"), F.lit(PARTS)))
        ordered = rows.hint("rebalance", "bucket", "part").drop("part").sortWithinPartitions("bucket", "term", "block")
        return commits.append(chunks.sparkSession, self.path, lambda folder: ordered.write.partitionBy("bucket").parquet(folder))

    def rows(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        at = commits.snapshot(spark, self.path, version)
        parts = [spark.read.schema(SCHEMA).parquet(f"{self.path}/{x}") for x in at.folders]
        out = spark.createDataFrame([], SCHEMA) if not parts else parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def asked_terms(questions: DataFrame, *, english: bool = True) -> DataFrame:
    """Rows (qid, slot, term, gap) of questions (qid, query): the distinct terms, each with its place among the words."""
    words = _words("query")
    terms = stems(words) if english else words
    rows = questions.select("qid", words.alias("words"), terms.alias("terms"))
    rows = rows.select("qid", F.posexplode(F.arrays_zip("words", "terms")).alias("slot", "w"))
    return rows.where(~F.col("w.words").isin(*_stop_words(english))).select("qid", "slot", F.col("w.terms").alias("term"))


def open_postings(index: TextIndex, asked: DataFrame) -> DataFrame:
    """The index's rows of asked terms: pushed into the scan as long as they are few, else joined by bucket and term."""
    spark = asked.sparkSession
    rows = index.rows(spark)
    wanted = asked.select("term").distinct()
    few = [r.term for r in wanted.limit(MOST_TERMS + 1).collect()]
    if len(few) <= MOST_TERMS:
        buckets = [r.bucket for r in spark.createDataFrame([(t,) for t in few], "term string").select(_bucket("term")).distinct().collect()]
        return rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(few))
    return rows.join(wanted.select("term", _bucket("term")), ["bucket", "term"], "left_semi")


def covers(places: list[np.ndarray]) -> float:
    """The density of the shortest runs that hold every one of some terms, by one pass over all places in order."""
    slot = np.repeat(np.arange(len(places)), [len(p) for p in places])
    at = np.concatenate(places)
    by = np.argsort(at, kind="stable")
    slot, at = slot[by].tolist(), at[by].tolist()
    last = [-1] * len(places)
    total, begun = 0.0, -1
    for k, s in enumerate(slot):
        last[s] = k
        first = min(last)
        # a run that starts where an earlier one did is longer than that
        if first > begun:
            begun = first
            total += COVER / (1 + (at[k] - at[first]) - (k - first))
    return total


def phrases(places: list[np.ndarray], slots: list[int]) -> float:
    """How often the terms follow one another at the places of the question, as density."""
    found = places[0] - slots[0]
    for p, s in zip(places[1:], slots[1:]):
        found = np.intersect1d(found, p - s, assume_unique=True)
    return COVER * len(found)


def _dense(rows: DataFrame, mode: str) -> DataFrame:
    """Rows (qid, id, score) of rows (qid, id, met), met being an array of (slot, term, places) with all terms of the question."""
    kind = f"qid {rows.schema['qid'].dataType.simpleString()}, id long, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for met in batch.column("met").to_pylist():
                met.sort(key=lambda m: m["slot"])
                places = [np.array(m["places"], np.int64) for m in met]
                if mode == "phrase":
                    scores.append(phrases(places, [m["slot"] for m in met]))
                else:
                    scores.append(covers(list({m["term"]: p for m, p in zip(met, places)}.values())))
            # sums of the same covers in another order are the same score
            scores = [round(s, 12) for s in scores]
            out = [batch.column("qid"), batch.column("id"), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(out, ["qid", "id", "score"])

    return rows.select("qid", "id", "met").mapInArrow(run, kind).where("score > 0")


def _scored(rows: DataFrame, mode: str) -> DataFrame:
    """Rows (qid, id, score) of posting rows with their questions, which are together by (qid, block): a passage is in one block."""
    passage = ["qid", "block", F.col("p.ids").alias("id")]
    if mode == "any":
        flat = rows.select("qid", "block", F.explode(F.arrays_zip("ids", "counts")).alias("p"))
        found = flat.groupBy(*passage).agg(F.sum("p.counts").alias("n"))
        return found.select("qid", "id", (F.col("n") * COVER).alias("score"))
    flat = rows.select("qid", "block", "slot", "term", "n_slots", F.explode(F.arrays_zip("ids", "places")).alias("p"))
    met = flat.groupBy(*passage).agg(
        F.collect_list(F.struct("slot", "term", F.col("p.places").alias("places"))).alias("met"), F.first("n_slots").alias("n")
    )
    return _dense(met.where(F.size("met") == F.col("n")), mode)


def _together(rows: DataFrame, visits: int) -> DataFrame:
    """Rows of the same question and block in one task, in as many tasks as there is work for."""
    return rows.repartition(1 + visits // VISITS, "qid", "block")


def search(
    index: TextIndex, questions: DataFrame, k: int, *, mode: str = "any", chunks: DataFrame | None = None, filters: dict[str, object] | None = None
) -> DataFrame:
    """Rows (qid, id, text_score, rank): the k best passages of each question (qid, query), ties by id.

    ``filters`` are on columns of ``chunks``, whose ids then restrict the answers.
    """
    checked_k(k)
    if mode not in MODES:
        raise ValueError(f"no mode {mode!r}")
    slots = asked_terms(questions, english=index.english)
    if mode != "phrase":
        # a term asked for twice is one term
        slots = slots.groupBy("qid", "term").agg(F.min("slot").alias("slot"))
    of_question = Window.partitionBy("qid")
    slots = stored(slots.withColumn("n_slots", F.count("*").over(of_question)), "asked-terms")
    rows = open_postings(index, slots).drop("bucket").join(slots, "term")
    if mode == "any":
        rows = rows.drop("places")

    reach = rows.groupBy("qid", "block").agg(F.sum("best").alias("bound"), F.countDistinct("slot").alias("held"), F.first("n_slots").alias("n_slots"))
    if mode != "any":
        reach = reach.where("held = n_slots")
    nearest = Window.partitionBy("qid").orderBy(F.desc("bound"), "block")
    reach = stored(reach.withColumn("nr", F.row_number().over(nearest)).select("qid", "block", "bound", "nr"), "reach")

    def visited(met: DataFrame) -> DataFrame:
        found = _scored(met, mode)
        if filters:
            found = found.join(chunks.where(metadata_predicate(filters)).select(F.col("id").cast("long").alias("id")), "id", "left_semi")
        return found.select("qid", "id", "score")

    best = reach.where(F.col("nr") <= FIRST).select("qid", "block")
    first = stored(top_k(visited(_together(rows.join(best, ["qid", "block"]), best.count())), k, F.desc("score"), F.asc("id")), "first-answers")
    floors = first.where(F.col("rank") == k).select("qid", F.col("score").alias("floor"))
    # a bound is never below a score, but for rounding
    least = F.coalesce(F.col("floor"), F.lit(0.0)) - 1e-9
    rest = reach.where(F.col("nr") > FIRST).join(floors, "qid", "left").where(F.col("bound") * COVER >= least)
    rest = stored(rest.select("qid", "block"), "rest")
    met = _together(rows, rest.count()).join(rest, ["qid", "block"])
    every = first.select("qid", "id", "score").unionByName(visited(met))
    return top_k(every, k, F.desc("score"), F.asc("id")).select("qid", "id", F.col("score").alias("text_score"), "rank")


def match_counts(index: TextIndex, questions: DataFrame) -> DataFrame:
    """Rows (qid, matches): how many passages hold any term of each question, zero where none does."""
    asked = asked_terms(questions, english=index.english).select("qid", "term").distinct()
    asked = stored(asked, "asked-terms")
    rows = open_postings(index, asked).select("term", "block", "ids").join(asked, "term")
    visits = rows.select("qid", "block").distinct().count()
    met = _together(rows, visits).select("qid", "block", F.explode("ids").alias("id")).distinct()
    found = met.groupBy("qid").agg(F.count("*").alias("n"))
    return questions.select("qid").join(found, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("matches"))


def searcher(index: TextIndex, **how: object) -> Search:
    """:func:`search` in the form that :func:`retrieval.retrieve` and :func:`retrieval.hybrid_search` take."""
    return lambda questions, chunks, k, filters=None: search(index, questions, k, chunks=chunks, filters=filters, **how)
