"""Results of models at rest, so that a text is paid for once: embeddings by text, scores by question and text.

A row's key is a digest of what the model was given. What a table lacks is found by
an anti-join, only that reaches the model, each key once, and the new rows are
committed as an append: readers of an earlier version are not disturbed, and two
runs that fill the same keys at once both commit, of which one row a key is read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import chunking, retrieval
from . import commits


def digest(*parts: str | Column) -> Column:
    """SHA-256 of texts, told apart from their concatenation and from nulls."""
    cells = [F.coalesce(F.sha2(F.col(p) if isinstance(p, str) else p, 256), F.lit("-")) for p in parts]
    return F.sha2(F.concat_ws("|", *cells), 256)


@dataclass(frozen=True)
class Cache:
    """Rows (model, digest, value) at ``path``; ``model`` names all that the value depends on beside the digest."""

    path: str
    model: str
    kind: str

    def stored(self, like: DataFrame) -> DataFrame:
        """Rows (digest, value), one a key."""
        rows = commits.read(like.sparkSession, self.path, f"digest string, value {self.kind}, model string")
        return rows.where(F.col("model") == self.model).groupBy("digest").agg(F.first("value").alias("value"))

    def filled(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Rows (digest, value) for the keys of ``wanted``, which has a column ``digest`` and what ``compute`` needs.

        ``compute`` gets the rows whose key is not stored, each key once, and adds ``value`` to them.
        """
        missing = wanted.join(self.stored(wanted).select("digest"), "digest", "left_anti").dropDuplicates(["digest"])
        if not missing.isEmpty():
            new = compute(missing).select("digest", F.col("value").cast(self.kind).alias("value"), F.lit(self.model).alias("model"))
            commits.append(wanted.sparkSession, self.path, lambda folder: new.write.parquet(folder))
        return self.stored(wanted).join(wanted.select("digest").distinct(), "digest", "left_semi")


def embedded(
    chunks: DataFrame, path: str, dimensions: int, model: Callable[[list[str], int], list[list[float]]] = chunking.hashed_embedding, *,
    name: str = "hashed", batch_size: int = 100
) -> DataFrame:
    """``chunks`` with ``embedding``, as :func:`chunking.embed` has them; texts that ``name`` has embedded before are read."""
    cache = Cache(path, f"{name}-{dimensions}", "array<float>")
    keyed = chunks.withColumn("__digest", digest("text"))
    found = cache.filled(
        keyed.select(F.col("__digest").alias("digest"), "text"),
        lambda rows: chunking.embed(rows, dimensions, model, batch_size).withColumnRenamed("embedding", "value"),
    )
    return keyed.join(found.select(F.col("digest").alias("__digest"), F.col("value").alias("embedding")), "__digest").drop("__digest")


def pair_scores(
    pairs: DataFrame, questions: DataFrame, chunks: DataFrame, path: str, scorer: retrieval.Scorer = retrieval.overlap_scorer, *,
    name: str = "overlap"
) -> DataFrame:
    """Rows (qid, id, rerank_score), as :func:`retrieval.pair_scores` has them; pairs of texts that ``name`` has scored before are read."""
    cache = Cache(path, name, "double")
    rows = pairs.select("qid", "id").join(chunks.select("id", "text"), "id").join(questions.select("qid", "query"), "qid")
    keyed = rows.select("qid", "id", digest("query", "text").alias("digest"), "query", "text")

    def compute(missing: DataFrame) -> DataFrame:
        # the scorer sees each pair of texts once, under its own key
        alone = missing.select(F.col("digest").alias("qid"), F.col("digest").alias("id"), "query", "text")
        scored = retrieval.pair_scores(alone, alone.select("qid", "query"), alone.select("id", "text"), scorer)
        return scored.select(F.col("qid").alias("digest"), F.col("rerank_score").alias("value"))

    found = cache.filled(keyed.select("digest", "query", "text"), compute)
    return keyed.join(found, "digest").select("qid", "id", F.col("value").alias("rerank_score"))
