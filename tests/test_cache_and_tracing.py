"""Models are asked once for each text; spans count their own jobs."""

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import chunking, retrieval
from ledgerline.plans import agent, runs, tracing
from ledgerline.sources import cache, commits

PRICES = [(0, "large", "model", "2", "0.5", "8"), (1, "vectors", "embedding", "0.02", None, None)]


def test_texts_are_embedded_once(spark, tmp_path):
    path, calls = str(tmp_path / "cache"), spark.sparkContext.accumulator(0)

    def model(texts, dimensions):
        calls.add(len(texts))
        return chunking.hashed_embedding(texts, dimensions)

    rows = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "a b"), (4, "")], "id long, text string")
    got = cache.embedded(rows, path, 8, model, name="m")
    want = {r.id: r.embedding for r in chunking.embed(rows, 8).collect()}
    assert {r.id: r.embedding for r in got.collect()} == want
    assert calls.value == 3
    for _ in range(2):
        assert {r.id: r.embedding for r in cache.embedded(rows, path, 8, model, name="m").collect()} == want
    assert calls.value == 3 and commits.snapshot(spark, path).version == 1
    more = rows.unionByName(spark.createDataFrame([(5, "new"), (6, "c")], "id long, text string"))
    assert cache.embedded(more, path, 8, model, name="m").count() == 6 and calls.value == 4
    # another model or size shares nothing
    cache.embedded(rows, path, 4, model, name="m").collect()
    assert calls.value == 7
    assert {len(r.embedding) for r in cache.embedded(rows, path, 8, model, name="m").collect()} == {8} and calls.value == 7


def test_pairs_are_scored_once(spark, tmp_path):
    path, calls = str(tmp_path / "scores"), spark.sparkContext.accumulator(0)

    def scorer(queries, texts):
        calls.add(len(texts))
        return retrieval.overlap_scorer(queries, texts)

    questions = spark.createDataFrame([(1, "cash flow"), (2, "cash flow"), (3, "debt")], "qid long, query string")
    chunks = spark.createDataFrame([(10, "cash is king"), (11, "debt"), (12, "cash is king")], "id long, text string")
    pairs = questions.select("qid").crossJoin(chunks.select("id"))
    want = sorted(map(tuple, retrieval.pair_scores(pairs, questions, chunks).collect()))
    for _ in range(2):
        assert sorted(map(tuple, cache.pair_scores(pairs, questions, chunks, path, scorer).collect())) == want
    assert calls.value == 4  # two texts of questions by two texts of chunks


def test_two_runs_that_fill_at_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    append = commits.append

    def slow(*a):
        monkeypatch.setattr(commits, "append", append)
        cache.embedded(rows, path, 8)
        return append(*a)

    monkeypatch.setattr(commits, "append", slow)
    assert cache.embedded(rows, path, 8).count() == 2
    assert commits.snapshot(spark, path).version == 2


def test_rows_are_counted_by_the_job_that_makes_them(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(100).mapInArrow(counting, "id long")
    with tracing.trace("load", trace_id="t1") as load:
        with tracing.span("outer"), tracing.span("write"):
            tracing.ran(rows, lambda df: df.write.parquet(str(tmp_path / "out")), total=F.sum("id"))
        with tracing.span("collect"):
            assert len(tracing.ran(spark.range(7), lambda df: df.collect(), "read_")) == 7
    assert seen.value == 100
    by = {s.name: s for s in load.spans}
    assert by["write"].counts == {"rows": 100, "total": 4950} and by["collect"].counts == {"read_rows": 7}
    assert by["write"].parent == by["outer"].number and by["outer"].parent is None and by["collect"].parent is None
    assert by["outer"].nanoseconds >= by["write"].nanoseconds > 0
    found = {r.stage: r for r in load.span_rows(spark).collect()}
    assert found["write"].counts["rows"] == 100 and found["outer"].latency_ms >= 1


def test_without_a_trace_nothing_is_noted(spark):
    with tracing.span("alone") as now:
        assert now is None and tracing.ran(spark.range(3), lambda df: df.count()) == 3
        tracing.called("large", "model", {"input_tokens": 1})


def test_calls_cost_their_stage(spark):
    with tracing.trace("q", trace_id="t", session_id="s") as request:
        with tracing.span("answer"):
            tracing.called("large", "model", {"input_tokens": 1000, "cached_tokens": 400, "output_tokens": 100})
            tracing.called("large", "model", {"input_tokens": 10, "cached_tokens": 99, "output_tokens": None})
        with tracing.span("retrieval"):
            tracing.called("vectors", "embedding", {"input_tokens": 50})
        with tracing.span("nothing"):
            pass
        with pytest.raises(ZeroDivisionError), tracing.span("fails"):
            1 / 0
    prices = spark.createDataFrame(PRICES, tracing.PRICES)
    found = {r.stage: r for r in request.stage_totals(spark, prices).collect()}
    cost = lambda n: (600 * 2 + 400 * 0.5 + 100 * 8 + 10 * 0.5 if n == "answer" else 50 * 0.02) / 1e6
    assert {n: float(found[n].cost) for n in ("answer", "retrieval")} == {n: pytest.approx(cost(n)) for n in ("answer", "retrieval")}
    assert found["answer"].input_tokens == 1010 and found["answer"].cached_tokens == 410 and found["nothing"].cost is None
    assert found["fails"].errors == 1 and request.spans[-1].error.startswith("ZeroDivisionError")
    row = request.log_row(spark, intent="numeric", route="sql_tool", grounded=True, prices=prices).first()
    assert (row.trace_id, row.session_id, row.question, row.input_tokens, row.output_tokens) == ("t", "s", "q", 1060, 100)
    assert float(row.cost_usd) == pytest.approx(cost("answer") + cost("retrieval")) and row.latency_ms >= 1


def test_a_question_and_its_spans(spark, tmp_path):
    facts = spark.createDataFrame(
        [("AAPL", "net_income", 2024, "FY", 5.0, "USD")], "ticker string, metric string, fiscal_year int, fiscal_period string, value double, unit string"
    )
    kind = "id long, ticker string, fiscal_year int, fiscal_period string, section string, text string"
    chunks = spark.createDataFrame([(1, "AAPL", 2023, "FY", "Notes", "risks drive net income")], kind)
    with tracing.trace("?", trace_id="x") as request:
        out = agent.ask(spark, "Why was AAPL net income high in FY2024?", {"financial_facts": facts}, chunks, {"AAPL"})
    assert out.route == "hybrid" and out.chunks == [1]
    names = [s.name for s in request.spans]
    assert names == ["guardrails", "understanding", "planning", "sql", "retrieval", "relaxed", "answer", "grounding"]
    by = {s.name: s for s in request.spans}
    assert by["sql"].counts["rows"] == 1 and by["retrieval"].counts["rows"] == 0 and by["relaxed"].counts["rows"] == 1
    assert by["relaxed"].parent == by["retrieval"].number
    log = request.log_row(spark, intent="hybrid", route=out.route, grounded=out.grounded)
    tracing.logged(log, str(tmp_path / "query_logs"))
    assert spark.read.parquet(str(tmp_path / "query_logs")).first().cost_usd == 0


def test_stages_of_a_load_are_spans(spark, tmp_path):
    def broken():
        raise OSError("no disk")

    def load():
        tracing.ran(spark.range(5), lambda df: df.write.parquet(str(tmp_path / "five")))

    with tracing.trace("load") as state, pytest.raises(RuntimeError, match="no disk"):
        runs.run_stages({"first": broken, "second": load})
    assert [(s.name, s.counts.get("rows"), bool(s.error)) for s in state.spans] == [("first", None, True), ("second", 5, False)]
