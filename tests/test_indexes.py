"""Indexes at rest against searches of all rows and brute force."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.functions.text import STOP_WORDS
from ledgerline.operators import retrieval, text_index, vector_index
from ledgerline.sources import commits

WORDS = ["risk", "cash", "flow", "net", "income", "the", "of", "growth", "debt", "tax", "and", "loss"]


def texts(n=400):
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(WORDS[int(w) % 12] for w in rng.zipf(1.5, rng.integers(1, 40))), f"T{k % 3}") for k in range(n)]
    rows += [(n, None, "T0"), (n + 1, "", "T0"), (n + 2, "The OF and", "T1"), (n + 3, "risk " * 30_000, "T2"), (n + 4, "Cash-flow: cash, FLOW!", "T1")]
    rows += [(n + 10 + k, "net income growth", "T0") for k in range(n // 2)]
    return rows


ASKED = [(1, "Cash flow risk"), (2, "the debt of tax"), (3, "income"), (4, "the of"), (5, "absent words"), (6, "tax tax loss"), (7, None), (8, "net growth absent")]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(texts(), "id long, text string, ticker string").repartition(3)


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(ASKED, "qid long, query string")


@pytest.fixture(scope="module", params=[(1024, 2), (17, 1)])
def index(request, chunks, tmp_path_factory):
    at = text_index.TextIndex(str(tmp_path_factory.mktemp("text") / "index"), english=False)
    before = text_index.BLOCK, text_index.FIRST
    text_index.BLOCK, text_index.FIRST = request.param
    at.add(chunks.where("id < 300"))
    at.add(chunks.where("id >= 300"))
    yield at
    text_index.BLOCK, text_index.FIRST = before


def words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def brute_cover(text, query):
    """All runs of words that hold every term and none of whose parts does."""
    terms, have = set(words(query)) - set(STOP_WORDS), words(text)
    holds = lambda a, b: terms <= set(have[a : b + 1])
    spans = [(a, b) for a in range(len(have)) for b in range(a, min(len(have), a + 60)) if holds(a, b)]
    least = [(a, b) for a, b in spans if not holds(a + 1, b) and not holds(a, b - 1)]
    return sum(0.1 / (1 + sum(w not in terms for w in have[a : b + 1])) for a, b in least) if terms else 0


def brute_phrase(text, query):
    have, want = words(text), [(k, w) for k, w in enumerate(words(query)) if w not in STOP_WORDS]
    return sum(all(0 <= a + k < len(have) and have[a + k] == w for k, w in want) for a in range(-20, len(have))) * 0.1 if want else 0


def best(scores, k):
    return sorted(((-round(s, 9), i) for i, s in scores.items() if s > 0))[:k]


def ranked(found):
    out = {}
    for r in found.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((-round(r.text_score, 9), r.id))
    return out


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_any_term_equals_a_search_of_all(index, chunks, questions, k):
    known = questions.where("query IS NOT NULL")
    assert ranked(text_index.search(index, questions, k)) == ranked(retrieval.text_search(known, chunks, k))


@pytest.mark.parametrize("mode, score", [("all", brute_cover), ("phrase", brute_phrase)])
def test_cover_density_equals_brute_force(index, questions, mode, score):
    rows = [(i, t) for i, t, _ in texts() if t is None or len(t) < 5000]
    for k in (5, 300):
        got = ranked(text_index.search(index, questions, k + 1, mode=mode))
        for qid, query in ASKED:
            want = best({i: score(t, query) for i, t in rows}, k + 1)
            mine = [x for x in got.get(qid, []) if x[1] != 403]
            assert mine[:k] == want[:k], (mode, qid)


def test_covers_by_hand():
    p = lambda *x: np.array(x)
    assert text_index.covers([p(0, 5)]) == pytest.approx(0.2)
    assert text_index.covers([p(0), p(1)]) == pytest.approx(0.1)
    assert text_index.covers([p(0), p(3)]) == pytest.approx(0.1 / 3)
    assert text_index.covers([p(0, 2), p(1)]) == pytest.approx(0.2)
    assert text_index.covers([p(0, 1, 9), p(4)]) == pytest.approx(0.1 / 3 + 0.1 / 5)
    assert text_index.phrases([p(0, 4), p(1, 9), p(3, 7)], [0, 1, 3]) == pytest.approx(0.1)


def test_filters_and_postings_that_are_read(index, chunks, questions, spark):
    wanted = {"ticker": ["T1"]}
    got = ranked(text_index.search(index, questions, 5, chunks=chunks, filters=wanted))
    assert got == ranked(retrieval.text_search(questions.where("query IS NOT NULL"), chunks, 5, wanted))
    opened = text_index.open_postings(index, text_index.asked_terms(questions.where("qid = 3"), english=False))
    plan = opened._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*(EqualTo|In)\(term", plan) and re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    assert {r.term for r in opened.collect()} == {"income"}
    scan = text_index.search(index, questions, 5)._jdf.queryExecution().executedPlan().toString()
    assert all("places" not in s for s in re.findall(r"ReadSchema: (\S+)", scan))


def test_many_terms_are_joined(index, questions, monkeypatch):
    want = ranked(text_index.search(index, questions, 7))
    monkeypatch.setattr(text_index, "MOST_TERMS", 2)
    assert ranked(text_index.search(index, questions, 7)) == want


def test_english_terms(spark, tmp_path):
    rows = [(1, "The filings described risks"), (2, "Filed: a risk was described"), (3, "They risked it while filing"), (4, "nothing here")]
    at = text_index.TextIndex(str(tmp_path / "english"))
    at.add(spark.createDataFrame(rows, "id long, text string"))
    ask = lambda q, mode: [r.id for r in text_index.search(at, spark.createDataFrame([(1, q)], "qid long, query string"), 9, mode=mode).orderBy("rank").collect()]
    assert ask("a risk of filing", "any") == [1, 2, 3] and ask("why is it here?", "any") == []
    assert ask("filing risks", "all") == [1, 2, 3]
    assert ask("describing risks", "phrase") == [1] and ask("filed, and a risk", "phrase") == []
    assert {r.term for r in at.rows(spark).collect()} == {"file", "describ", "risk", "noth"}


def test_no_text_index_and_wrong_modes(spark, questions, tmp_path, chunks):
    none = text_index.TextIndex(str(tmp_path / "none"))
    assert text_index.search(none, questions, 3).collect() == []
    with pytest.raises(ValueError):
        text_index.search(none, questions, 3, mode="near")
    none.add(chunks.limit(0))
    assert text_index.search(none, questions, 3).collect() == []


def vectors(spark, n=3000, d=24):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, d))
    x = centres[rng.integers(0, 40, n)] + 0.4 * rng.normal(size=(n, d))
    x[n // 2 : n // 2 + n // 3] = x[7]  # a third are copies
    rows = [(k, v.tolist(), f"T{k % 2}") for k, v in enumerate(x)]
    rows += [(n, None, "T0"), (n + 1, [0.0] * d, "T0"), (n + 2, [1.0], "T0"), (n + 3, [float("nan")] * d, "T1"), (None, x[0].tolist(), "T0")]
    return spark.createDataFrame(rows, "id long, embedding array<double>, ticker string").repartition(4)


def answers(found):
    out = {}
    for r in found.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((r.id, round(r.vector_score, 9)))
    return out


@pytest.fixture(scope="module")
def embedded(spark, tmp_path_factory):
    rows = vectors(spark).cache()
    at = vector_index.VectorIndex(str(tmp_path_factory.mktemp("vectors") / "index"))
    at.create(rows.where("id < 2500"))
    at.add(rows.where("id >= 2500"))
    asked = rows.where("id % 100 = 0 AND id < 3000").select(F.col("id").alias("qid"), "embedding")
    return rows, at, asked


def test_all_probes_are_exact(embedded, monkeypatch):
    rows, at, asked = embedded
    usable = rows.where("id IS NOT NULL AND id NOT IN (3000, 3001, 3002, 3003)")
    want = answers(retrieval.vector_search(asked, usable, 10))
    assert answers(vector_index.search(at, asked, 10, probes=vector_index.EVERY)) == want
    for name, value in (("PART", 100), ("TOGETHER", 7)):
        monkeypatch.setattr(vector_index, name, value)
    assert answers(vector_index.search(at, asked, 10, probes=10_000)) == want
    t1 = {"ticker": "T1"}
    assert answers(vector_index.search(at, asked, 10, probes=vector_index.EVERY, chunks=rows, filters=t1)) == answers(retrieval.vector_search(asked, usable, 10, t1))


def test_few_probes_find_most(embedded, spark):
    rows, at, asked = embedded
    model = at.model(spark)
    assert 1 <= model.probes < len(model.centres) / 2
    exact = answers(vector_index.search(at, asked, 10, probes=vector_index.EVERY))
    near = answers(vector_index.search(at, asked, 10))
    found = sum(len({s for _, s in near[q]} & {s for _, s in exact[q]}) for q in exact)
    assert found >= 0.9 * sum(len({s for _, s in exact[q]}) for q in exact)


def test_bounds_hold_the_true_cosine():
    rng = np.random.default_rng(0)
    x = vector_index._unit(rng.normal(size=(500, 20)))
    model = vector_index.Model.unpacked(vector_index.Model.learnt(x).packed())
    cell, codes, error = model.encoded(x)
    for q, c in itertools.product(vector_index._unit(rng.normal(size=(5, 20))), set(cell.tolist())):
        here = cell == c
        gap = np.abs(model.estimates(q, c, codes[here]) - x[here] @ q)
        assert (gap <= error[here] + vector_index.SLACK).all()


def test_probes_grow_where_vectors_have_no_clusters():
    rng = np.random.default_rng(3)
    clear = vector_index.Model.learnt(np.repeat(np.eye(32), 20, axis=0) + 0.01 * rng.normal(size=(640, 32)))
    noise = vector_index.Model.learnt(rng.normal(size=(640, 32)))
    assert clear.probes <= 4 < noise.probes <= len(noise.centres)
    assert vector_index.Model.learnt(np.ones((1, 3))).probes == 1 and vector_index.Model.learnt(np.ones((40, 3))).probes == 1


def test_wrong_questions_and_no_vectors(embedded, spark, tmp_path):
    _, at, asked = embedded
    with pytest.raises(Exception, match="not valid"):
        vector_index.search(at, spark.createDataFrame([(1, [1.0])], "qid long, embedding array<double>"), 3).collect()
    none = spark.createDataFrame([(1, None)], "id long, embedding array<double>")
    with pytest.raises(ValueError, match="no vectors"):
        vector_index.VectorIndex(str(tmp_path / "v")).create(none)
    assert vector_index.search(at, asked.limit(0), 3).collect() == []
    assert commits.snapshot(spark, f"{at.path}/rows").version == 2


def test_strategies_over_indexes(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(k, t, f"T{k % 3}", rng.normal(size=8).tolist()) for k, t, _ in texts(60) if t]
    chunks = spark.createDataFrame(rows, "id long, text string, ticker string, embedding array<double>")
    asked = spark.createDataFrame([(1, "cash flow risk", rows[5][3]), (2, "tax", rows[9][3])], "qid long, query string, embedding array<double>")
    words = text_index.TextIndex(str(tmp_path / "words"), english=False)
    words.add(chunks)
    near = vector_index.VectorIndex(str(tmp_path / "near"))
    near.create(chunks)
    legs = {"text": text_index.searcher(words), "vector": vector_index.searcher(near, probes=vector_index.EVERY)}
    for strategy in ("vector", "hybrid", "hybrid_rerank"):
        for filters in (None, {"ticker": ["T1", "T2"]}):
            ids = [
                [(r.qid, r.id) for r in retrieval.retrieve(asked, chunks, filters, strategy=strategy, k=6, n=3, **how).orderBy("qid", "rank").collect()]
                for how in ({}, legs)
            ]
            assert ids[0] == ids[1] and len(ids[0]) == 6
    counts = {r.qid: r.matches for r in text_index.match_counts(words, asked).collect()}
    assert counts == {r.qid: r.matches for r in retrieval.text_match_counts(asked, chunks).collect()}


def test_a_search_of_vectors_shuffles_the_best_alone(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 8)))], "id long, embedding array<double>")
    at = vector_index.VectorIndex(str(tmp_path / "few"))
    at.create(rows)
    asked = rows.where("id % 20 = 0").withColumnRenamed("id", "qid")
    found = vector_index.search(at, asked, 3, probes=vector_index.EVERY)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "Join" not in plan and answers(found) == answers(retrieval.vector_search(asked, rows, 3))


def test_a_term_that_is_everywhere_is_written_by_more_tasks_as_it_grows(spark, tmp_path):
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    index = text_index.TextIndex(f"file://{tmp_path}/wide", english=False)
    chunks = spark.range(40_000).selectExpr("id", "repeat('word ', CAST(id % 7 + 1 AS INT)) AS text").repartition(16)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        index.add(chunks)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = {f.rsplit("/", 1)[1] for f in index.rows(spark).inputFiles()}
    assert len(files) > text_index.PARTS
    questions = spark.createDataFrame([(1, "a word"), (2, "none")], "qid long, query string")
    assert {(r.qid, r.matches) for r in text_index.match_counts(index, questions).collect()} == {(1, 40_000), (2, 0)}
    assert [r.id for r in text_index.search(index, questions, 3).orderBy("rank").collect()] == [6, 13, 20]


def test_scores_need_as_many_tasks_as_there_are_visits(spark):
    rows = spark.range(10).selectExpr("id AS qid", "id AS block", "array(id) AS ids", "array(1) AS counts")
    met = text_index._together(rows, 10 * text_index.VISITS)
    plan = text_index._scored(met, "any")._jdf.queryExecution().executedPlan().toString()
    assert met.rdd.getNumPartitions() == 11 and plan.count("Exchange") == 1
