"""The training-corpus pipeline: filters, deduplication, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents.

Defined results, for all stages: null and empty texts are never toxic, near
copies or contaminated, lose no lines, and are packed as the end id alone; rows
with a null id, and every row of an id that stands in several, are kept or
dropped by their own text (near copies: by their id) and packed each on its own;
texts count whole at any length; of near copies the smallest id stays, however
they tie; empty tables pass through; columns besides doc_id, source and text
pass through all but the last stage, whatever their names (``__`` begins the
operators' own).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import line_spread, packing, simhash, toxicity, winnowing
from ledgerline.llm.storage import forget_since, tables_made, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 by a model of the labelled ones that are not held out."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without lines that ten sites print beside ten different lines, so that the lines of copied documents stay."""
    kept = line_spread.remove_boilerplate(docs, min_neighbours=10).select(*docs.columns)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 or more of their five-word shingles the one with the smallest id."""
    return simhash.first_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten words in a row, and no whole shorter item, with the benchmark."""
    return winnowing.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    found = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: Learnt scores, fingerprints and token ids cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = tables_made()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        # what the stage read and made on its way is in its result
        forget_since(spark, mark)
    return docs
