"""Whole runs: ground truth, retrieval comparison, numeric evaluation, ingestion."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions.text import size_bucket
from ..operators import chunking, evaluation, facts, repair, retrieval
from ..session import shared_folder, stored
from ..sources import cache, commits, filings, tables
from . import tracing

#: compared in this order; ties go to the earlier. The production strategy is a parameter of the comparison.
APPROACHES = ("text_search", "vector_search", "hybrid_rrf", "hybrid_rrf_rerank", "vector_rerank")
Generator = Callable[[list[str]], list[tuple[str, bool]]]


def template_questions(texts: list[str]) -> list[tuple[str, bool]]:
    """A deterministic stand-in for a question generator."""
    return [
        (f"What does the issuer say about {' and '.join(sorted(set(t.lower().split()), key=lambda w: (-len(w), w))[:6])} in its filing?", bool(t.strip())) for t in texts
    ]


def ground_truth(
    chunks: DataFrame, n: int, generate: Generator = template_questions, *, candidates: int | None = None,
    seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(accepted questions, histogram of rejections): a stratified sample of chunks, one question each, checked, made distinct and balanced.

    ``chunks`` have id, accession_no, section, chunk_index, ticker, name, text and token_count.
    """
    strata = ["ticker", "section", "bucket"]
    picked = evaluation.stratified_sample(
        chunks.withColumn("bucket", size_bucket("token_count")), strata, ["accession_no", "section", "chunk_index"],
        candidates or 3 * n, seed
    )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = generate(batch.column("text").to_pylist())
            if len(found) != batch.num_rows:
                raise ValueError("the generator's questions do not fit the texts")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([q for q, _ in found], pa.string()), pa.array([s for _, s in found], pa.bool_())],
                [*batch.schema.names, "question", "specific"]
            )

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema)
    asked = picked.mapInArrow(ask, f"{kind}, question string, specific boolean").withColumn("source", F.col("text")).withColumn(
        "issuer", evaluation.issuer_text("ticker", "name")
    )
    judged = evaluation.question_quality(asked, V.QUESTION_STOP_WORDS, V.GENERIC_WORDS)
    twin = F.row_number().over(facts.Window.partitionBy(F.lower(F.trim("question")), "reason").orderBy("id"))
    judged = judged.withColumn(
        "reason", F.when((F.col("reason") == "accepted") & (twin > 1), "duplicate").otherwise(F.col("reason"))
    )
    good = evaluation.stratified_sample(
        judged.where("reason = 'accepted'"), strata, ["accession_no", "section", "chunk_index"], n, seed + 1
    )
    return good.select(
        "id", "accession_no", "section", "chunk_index", "ticker", "question", "overlap"
    ), judged.groupBy("reason").agg(F.count("*").alias("n"))


def current_ids(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pairs with today's chunk ids by identity; a missing chunk or another ticker is an error."""
    now = chunks.select(F.col("id").alias("now"), "accession_no", "section", "chunk_index", F.col("ticker").alias("t"))
    found = pairs.join(now, ["accession_no", "section", "chunk_index"], "left")
    bad = F.col("now").isNull() | (F.col("t") != F.col("ticker"))
    checked = F.when(
        bad, F.raise_error(F.concat(F.lit("no such chunk: "), "accession_no")).cast("long")
    ).otherwise(F.col("now"))
    return found.select("qid", checked.alias("id"))


def compare_retrieval(
    questions: DataFrame, chunks: DataFrame, pairs: DataFrame, *, cutoffs: tuple[int, ...] = (5, 10), primary: int = 10,
    caps: tuple[int, ...] = (10, 50, 100), expected_fingerprint: str | None = None, production: str = "vector_rerank",
    scorer: retrieval.Scorer = retrieval.overlap_scorer, text: retrieval.Search = retrieval.text_search,
    vector: retrieval.Search = retrieval.vector_search, scores_at: str | None = None, scorer_name: str = "overlap"
) -> tuple[DataFrame, dict[str, object]]:
    """(metrics of each approach and cutoff, the best approach and whether production uses it). Questions are (qid, query, embedding).

    All questions go through one plan for each approach. With a fingerprint, another corpus is an error. ``text`` and
    ``vector`` may be searches of indexes. With ``scores_at``, scores of the reranker are kept there from run to run.
    """
    if expected_fingerprint is not None and evaluation.corpus_fingerprint(chunks).first()[0] != expected_fingerprint:
        raise ValueError("the corpus is not the one of the ground truth")
    k = max(cutoffs)
    # both legs are searched once, at the widest they are asked for; every list is a part or a fusion of them
    widest = 2 * k * retrieval.WIDEN
    folder = f"{shared_folder(chunks.sparkSession)}/legs-{uuid.uuid4().hex}"
    legs = {}
    for name, search in (("text", text), ("vector", vector)):
        found = search(questions, chunks, widest, None)
        found.write.parquet(f"{folder}/{name}")
        legs[name] = chunks.sparkSession.read.schema(found.schema).parquet(f"{folder}/{name}")
    first = lambda ranked, n: ranked.where(F.col("rank") <= n)
    hybrid = retrieval.fuse(legs["text"], legs["vector"], 2 * k)
    lists = {
        "text_search": first(legs["text"], k), "vector_search": first(legs["vector"], k), "hybrid_rrf": first(hybrid, k)
    }
    wanted = {"hybrid_rrf_rerank": hybrid, "vector_rerank": first(legs["vector"], 2 * k)}
    for cap in caps:
        capped = retrieval.fuse(legs["text"], legs["vector"], 2 * k, text_cap=cap)
        lists[f"hybrid_rrf_cap{cap}"] = first(capped, k)
        wanted[f"hybrid_rrf_cap{cap}_rerank"] = capped
    # a pair of question and chunk is scored once, whichever lists hold it
    pairs_of = reduce(DataFrame.unionByName, [r.select("qid", "id") for r in wanted.values()]).distinct()
    if scores_at:
        scored = cache.pair_scores(pairs_of, questions, chunks, scores_at, scorer, name=scorer_name)
    else:
        scored = retrieval.pair_scores(pairs_of, questions, chunks, scorer)
    scored.write.parquet(f"{folder}/scores")
    scores = chunks.sparkSession.read.parquet(f"{folder}/scores")
    for name, ranked in wanted.items():
        lists[name] = retrieval.reranked(ranked, scores, k)
    rows = None
    for name, ranked in lists.items():
        part = evaluation.retrieval_metrics(pairs, ranked, cutoffs).withColumn("approach", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    best = evaluation.best_approach(
        rows.where((F.col("cutoff") == primary) & F.col("approach").isin(*APPROACHES)), list(APPROACHES)
    ).first()
    return rows, {"best": best["approach"], "production_confirmed": best["approach"] == production}


def run_numeric(spark: SparkSession, cases: list[dict], answer: Callable[[str], list[tuple] | None]) -> DataFrame:
    """Scores of a stated set of cases (case_id, question, required, allowed, expect_refusal); an answer that raises is an execution error."""
    key = lambda f: "|".join(map(str, f))
    rows = []
    for case in cases:
        try:
            got = answer(case["question"])
            rows.append((case["case_id"], 1, bool(got), [key(f) for f in got or []]))
        except Exception:  # noqa: BLE001
            rows.append((case["case_id"], 1, None, None))
    outcomes = spark.createDataFrame(rows, "case_id string, seq int, grounded boolean, returned array<string>")
    known = spark.createDataFrame(
        [(c["case_id"], c["expect_refusal"], [key(f) for f in c["required"]], [key(f) for f in c["allowed"]]) for c in cases],
        "case_id string, expect_refusal boolean, required array<string>, allowed array<string>"
    )
    return evaluation.score_numbers(known, outcomes)


def freeze(cases: DataFrame, chunks: DataFrame, path: str) -> str:
    """Commits a set of cases with the digest of the corpus that it was made from; returns the digest."""
    digest = evaluation.corpus_digest(chunks).first()[0]
    tables.write_dataset(cases.withColumn("corpus", F.lit(digest)), path)
    return digest


def frozen(spark: SparkSession, path: str, schema: str, chunks: DataFrame | None = None) -> DataFrame:
    """The cases of the last frozen set; an error if there are none, or if ``chunks`` are not the corpus they were made from."""
    rows = commits.read(spark, path, f"{schema}, corpus string", format="json")
    made = [r.corpus for r in rows.select("corpus").distinct().limit(2).collect()]
    if not made:
        raise ValueError(f"no cases are frozen at {path}")
    if chunks is not None and made != [evaluation.corpus_digest(chunks).first()[0]]:
        raise ValueError("the corpus is not the one of the frozen cases")
    return rows.drop("corpus")


#: A judge's scores of answers to questions, each a mapping of ``evaluation.JUDGED`` and ``cited``.
Judge = Callable[[list[str], list[str | None]], list[dict[str, float | bool | None]]]


def judged(candidates: DataFrame, questions: DataFrame, judge: Judge) -> DataFrame:
    """Rows (prompt, case_id, scores, cited) of answers (prompt, qid, answer); an answer that is not there is scored as nothing."""
    kind = "prompt string, case_id string, " + ", ".join(f"{c} double" for c in evaluation.JUDGED) + ", cited boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = judge(batch.column("question").to_pylist(), batch.column("answer").to_pylist())
            if len(scores) != batch.num_rows:
                raise ValueError("the judge's scores do not fit the answers")
            given = [s if a is not None else {} for s, a in zip(scores, batch.column("answer").to_pylist())]
            columns = [pa.array([s.get(c) for s in given], pa.float64()) for c in evaluation.JUDGED]
            cited = pa.array([bool(s.get("cited")) for s in given], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("prompt"), batch.column("case_id"), *columns, cited], [*("prompt", "case_id"), *evaluation.JUDGED, "cited"])

    rows = candidates.join(questions.select("qid", "question"), "qid")
    return rows.select("prompt", F.col("qid").cast("string").alias("case_id"), "question", "answer").mapInArrow(run, kind)


NUMERIC_SET = "case_id string, question string, expect_refusal boolean, required array<struct<metric:string,fiscal_year:int,fiscal_period:string,value:double,unit:string>>"
NARRATIVE_SET = "qid string, question string"


def evaluate_generation(
    spark: SparkSession, numeric_at: str, narrative_at: str, chunks: DataFrame, *, answer: Callable[[str], list[tuple] | None],
    prompts: dict[str, str], write: Callable[[str, list[str]], list[str]], judge: Judge, runs_at: str
) -> dict[str, object]:
    """A whole run over both frozen sets: numbers that are right, prompts as a judge sees them, the best prompt, all persisted.

    Every prompt is scored over all narrative cases, whether it answered them or not.
    """
    rows = frozen(spark, numeric_at, NUMERIC_SET, chunks).collect()  # a stated set
    cases = [r.asDict() | {"required": [tuple(f) for f in r.required], "allowed": [tuple(f) for f in r.required]} for r in rows]
    numeric = run_numeric(spark, cases, answer)
    questions = frozen(spark, narrative_at, NARRATIVE_SET, chunks)
    scored = stored(judged(evaluation.narrative_candidates(questions, prompts, write), questions, judge), "judged")
    summary = stored(evaluation.judge_summary(scored, questions.count()), "prompts")
    best = evaluation.best_prompt(summary, list(prompts)).first()
    config = {"prompts": list(prompts), "cases": len(cases)}
    ids = [persist(m, config, kind, runs_at).first()[0] for kind, m in (("generation_numeric", numeric), ("generation_prompts", summary))]
    return {"numeric": numeric.first().asDict(), "best_prompt": best["prompt"], "composite": best["composite"], "runs": ids}


def persist(metrics: DataFrame, config: dict, kind: str, path: str) -> DataFrame:
    """Append a run's metrics as one row; returns its id."""
    row = metrics.agg(F.to_json(F.collect_list(F.struct(*metrics.columns))).alias("metrics"))
    return tables.append_runs(
        row.withColumn("config", F.lit(json.dumps(config, sort_keys=True))).withColumn("kind", F.lit(kind)), path
    )


def ingest_facts(
    payloads: DataFrame, companies: DataFrame, stored: DataFrame, cursor: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts after the load, the cursor after it, summary by status). A bad record is rejected alone."""
    good, bad = facts.fact_candidates(payloads, companies)
    fresh = facts.latest_facts(good).select(*stored.columns)
    after = facts.load_facts(stored, fresh, cursor.select("cik", "last_filing_date"))
    counts = good.select(F.lit("OK").alias("status")).unionByName(
        bad.select(F.col("reject_reason").alias("status"))
    ).groupBy("status").agg(F.count("*").alias("rows"))
    return after, facts.advance_cursor(cursor, after), counts


def ingest_documents(
    found: DataFrame, documents: DataFrame, known_facts: DataFrame, *, dimensions: int = 64, max_tokens: int = 700,
    overlap: float = 0.15, embeddings_at: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(embedded chunks ready to replace their filings, sections that could not be read). ``documents`` are (accession_no, html).

    With ``embeddings_at``, vectors of texts are kept there, and a text that was embedded before is not embedded again. A
    filing that stands twice with other metadata is an error.
    """
    facts.checked_metadata(found, "accession_no", ["cik", "form_type"])
    placed = facts.fiscal_context(found, known_facts)
    cleaned = repair.clean_filings(
        placed.join(documents, "accession_no"), "accession_no", "form_type", "html"
    ).withColumnRenamed("doc", "accession_no")
    chunks = chunking.chunk_sections(
        cleaned.where("section IS NOT NULL"), ["accession_no", "section"], max_tokens, overlap
    )
    embedded = cache.embedded(chunks, embeddings_at, dimensions) if embeddings_at else chunking.embed(chunks, dimensions)
    rows = embedded.join(placed.drop("form_type"), "accession_no")
    return rows, cleaned.where("note IS NOT NULL").select("accession_no", "section", "note")


def discover(payloads: DataFrame, cursor: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """New filings of landed submissions (cik, json), oldest first; ``history`` (cik, name, json) are landed history files.

    Those files are read that may hold filings from the cursor's day on; one that is listed, wanted and not landed is an error.
    """
    found = filings.submission_filings(payloads)
    wanted = filings.history_files(payloads, cursor)
    landed = wanted.join(history, ["cik", "name"], "left") if history is not None else wanted.withColumn(
        "json", F.lit(None).cast("string")
    )
    missing = F.raise_error(F.concat(F.lit("history file is not landed: "), "name")).cast("string")
    older = landed.select("cik", "part", F.coalesce("json", missing).alias("json"))
    return filings.new_filings(found.unionByName(filings.submission_filings(older)), cursor)


@dataclass
class Stage:
    name: str
    seconds: float
    error: str | None = None


def run_stages(stages: dict[str, Callable[[], None]], spans: list[Stage] | None = None) -> list[Stage]:
    """Run every stage, also after one has failed, and time each; raises in the end if any failed. ``spans`` receives them as they end.

    Each is a span of the open trace, if there is one; rows that it writes through :func:`tracing.ran` are its counts.
    """
    done = [] if spans is None else spans
    for name, stage in stages.items():
        began, error = time.monotonic(), None
        try:
            with tracing.span(name):
                stage()
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"[:500]
        done.append(Stage(name, time.monotonic() - began, error))
    if failed := [f"{s.name} ({s.error})" for s in done if s.error]:
        raise RuntimeError("stages failed: " + "; ".join(failed))
    return done
