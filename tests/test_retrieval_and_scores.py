import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.operators import evaluation, operations, retrieval


def ranked(spark, ids, score):
    return spark.createDataFrame(
        [(1, i, 1.0, k + 1) for k, i in enumerate(ids)], f"qid int, id long, {score} double, rank int"
    )


def test_fusion_order_and_score(spark):
    got = retrieval.fuse(
        ranked(spark, [1, 2], "text_score"), ranked(spark, [3, 2], "vector_score"), 3, rrf_k=10
    ).orderBy("rank").collect()
    assert [r.id for r in got] == [2, 1, 3]
    assert got[0].rrf_score == pytest.approx(1 / 12 + 1 / 12)
    capped = retrieval.fuse(ranked(spark, [1, 2], "text_score"), ranked(spark, [3, 2], "vector_score"), 3, text_cap=1)
    assert [r.id for r in capped.orderBy("rank").collect()] == [1, 3, 2]


def chunks(spark):
    rows = [
        (1, "AAPL", 2024, "FY", "MD&A", "cash and cash flow", [1.0, 0.0]),
        (2, "AAPL", None, "Q1", "Notes", "the cash", [0.6, 0.8]),
        (3, "MSFT", 2023, "FY", "Notes", "other words", [0.0, 0.0]), (4, "MSFT", 2023, "FY", "Notes", None, None),
        (5, "MSFT", 2023, "FY", "Notes", "x", [1.0])
    ]
    return spark.createDataFrame(
        rows,
        "id long, ticker string, fiscal_year int, fiscal_period string, section string, text string, embedding array<float>"
    )


def test_text_search_counts_places(spark):
    q = spark.createDataFrame([(1, "the Cash?"), (2, "of the"), (3, "absent")], "qid int, query string")
    got = retrieval.text_search(q, chunks(spark), 5).orderBy("qid", "rank").collect()
    assert [(r.qid, r.id, round(r.text_score, 3), r.rank) for r in got] == [(1, 1, 0.2, 1), (1, 2, 0.1, 2)]
    counts = retrieval.text_match_counts(q, chunks(spark))
    assert {r.qid: r.matches for r in counts.collect()} == {1: 2, 2: 0, 3: 0}


def test_stemmed_search(spark):
    q = spark.createDataFrame([(1, "flows")], "qid int, query string")
    assert retrieval.text_search(q, chunks(spark), 5).count() == 0
    assert [r.id for r in retrieval.text_search(q, chunks(spark), 5, stemmed=True).collect()] == [1]


def test_vector_search_is_exact_and_filters_first(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "qid int, embedding array<double>")
    got = retrieval.vector_search(q, chunks(spark), 2, block=1).orderBy("qid", "rank").collect()
    assert [(r.qid, r.id) for r in got] == [(1, 1), (1, 2), (2, 2), (2, 1)]
    assert got[1].vector_score == pytest.approx(0.6)
    assert retrieval.vector_search(q, chunks(spark), 2, {"ticker": "msft"}).count() == 0
    with pytest.raises(ValueError):
        retrieval.vector_search(
            spark.createDataFrame([(1, [float("nan"), 0.0])], "qid int, embedding array<double>"), chunks(spark), 2
        )


def test_predicates(spark, tmp_path):
    keep = lambda f: sorted(r.id for r in chunks(spark).where(retrieval.metadata_predicate(f)).collect())
    assert keep({"ticker": " aapl ", "fiscal_year": [2024, None]}) == [1, 2]
    assert keep(None) == [1, 2, 3, 4, 5]
    for bad in ({"color": "x"}, {"ticker": []}, {"fiscal_year": True}, {"fiscal_period": "Q7"}, {"section": " "}):
        with pytest.raises(ValueError):
            retrieval.metadata_predicate(bad)
    chunks(spark).write.parquet(str(tmp_path / "c"))
    plan = spark.read.parquet(str(tmp_path / "c")).where(
        retrieval.metadata_predicate({"fiscal_year": [2023, 2024, None]})
    ).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(In" in plan and "embedding" not in plan


def test_relaxed_retrieval(spark):
    q = spark.createDataFrame([(1, "cash", [1.0, 0.0])], "qid int, query string, embedding array<double>")
    assert retrieval.retrieve(q, chunks(spark), {"ticker": "AAPL", "fiscal_year": 1999}).count() == 0
    got = retrieval.retrieve(q, chunks(spark), {"ticker": "AAPL", "fiscal_year": 1999}, relax=True, n=1).collect()
    assert [r.id for r in got] == [1]
    with pytest.raises(ValueError):
        retrieval.retrieve(q, chunks(spark), strategy="magic")


def test_metrics_golden(spark):
    pairs = spark.createDataFrame([(1, 10), (2, 20)], "qid int, id long")
    ranks = spark.createDataFrame([(1, 5, 1), (1, 10, 2), (2, 20, 1)], "qid int, id long, rank int")
    got = {r.cutoff: (r.hit_rate, r.mrr, r.ndcg) for r in evaluation.retrieval_metrics(pairs, ranks, (1, 2)).collect()}
    assert got == {1: (0.5, 0.5, 0.5), 2: (1.0, 0.75, 0.815465)}


def test_match_stats_golden(spark):
    row = evaluation.match_stats(spark.createDataFrame([(0,), (2000,), (2500,), (2500,)], "matches long")).first()
    assert tuple(row) == (1750.0, 0, 2500, 1)


def test_numeric_scoring_golden(spark):
    cases = spark.createDataFrame(
        [("a", False, ["x"], ["x"]), ("b", False, ["y"], ["y"]), ("t", True, [], [])],
        "case_id string, expect_refusal boolean, required array<string>, allowed array<string>"
    )
    outcomes = spark.createDataFrame(
        [("a", 1, True, ["x"]), ("b", 1, True, ["wrong"]), ("t", 1, True, [])],
        "case_id string, seq int, grounded boolean, returned array<string>"
    )
    r = evaluation.score_numbers(cases, outcomes).first()
    assert (
        r.exact_match_rate, r.grounded_rate, r.empty_or_refusal_rate, r.false_number_rate, r.correct_refusal_rate,
        r.execution_error_rate
    ) == (0.5, 1.0, 0.333333, 0.5, 1.0, 0.0)
    assert r.failed_case_ids == ["b"]


def test_penalised_mean(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert df.agg(evaluation.penalised_mean(F.col("v"), 2)).first()[0] == 0.5


def test_samples_are_balanced_and_repeatable(spark):
    rows = spark.range(180).selectExpr("id", "concat('T', id % 2) AS ticker", "concat('S', id % 3) AS section")
    once = evaluation.stratified_sample(rows, ["ticker", "section"], ["id"], 12).collect()
    assert sorted(once) == sorted(
        evaluation.stratified_sample(rows.repartition(7), ["ticker", "section"], ["id"], 12).collect()
    )
    assert len({(r.ticker, r.section) for r in once}) == 6 and len(once) == 12


def test_question_checks(spark):
    source = "the company expects higher demand for cloud services during the next fiscal year in europe"
    ask = lambda q, s=True: (q, s, source, "AAPL Apple")
    rows = [
        ask("How does Apple plan growth while regional demand for computing products rises?"),
        ask("Does Apple see higher demand for cloud services during the coming period?"),
        ask("What happened at Apple in the year that they had then?"), ask("x?"), ask("No mark here", True),
        ask("Generic?", False), ask("What does the passage say about Apple demand growth margins today?"),
        ask("How does growth change while regional demand for computing products rises?")
    ]
    got = [
        r.reason for r in evaluation.question_quality(spark.createDataFrame(rows, "question string, specific boolean, source string, issuer string"), X.STOP_WORDS + ("what", "happened", "year", "had", "does", "how"), ()).collect()
    ]
    assert got == [
        "accepted", "copied_phrase", "too_generic", "invalid_length", "missing_question_mark", "model_marked_generic",
        "meta_reference", "issuer_missing"
    ]


def test_costs_golden(spark):
    calls = spark.createDataFrame(
        [(" big ", "model", 1000, 400, 200), ("small", "model", 1000, 400, 200), ("none", "model", 9, 9, 9)],
        "model string, kind string, input_tokens long, cached_tokens long, output_tokens long"
    )
    prices = spark.createDataFrame(
        [(0, "big", "model", "2", "0.5", "8"), (1, "small", "model", "0.2", "0.05", "0.8")],
        "rank int, model string, kind string, input string, cached string, output string"
    )
    assert sorted(float(r.cost) for r in operations.call_cost(calls, prices).collect()) == [0.0, 0.0003, 0.003]


def test_usage_shapes(spark):
    rows = [
        '{"input_tokens": 10, "output_tokens": 3, "input_tokens_details": {"cached_tokens": 40}}',
        '{"prompt_tokens": "7", "completion_tokens": -1}', "no json", None
    ]
    got = [
        tuple(r.u) for r in spark.createDataFrame([(x,) for x in rows], "raw string").select(operations.usage("raw").alias("u")).collect()
    ]
    assert got == [(10, 10, 3), (7, 0, 0), (0, 0, 0), (0, 0, 0)]


def test_scalar_functions(spark):
    one = lambda c, **v: spark.createDataFrame([tuple(v.values())], list(v)).select(c).first()[0]
    assert one(X.normal_ticker("t"), t=" brk.b ") == "BRK-B" and one(X.normal_ticker("t"), t="?") is None
    assert one(X.normal_metric("m"), m="NET SALES") == "revenue" and one(X.normal_metric("m"), m="gross_margin") is None
    assert [
        tuple(x) for x in one(X.fiscal_references("q"), q="Q1 of FY2024 against fy 2025, FY2025")
    ] == [("Q1", 2024), ("FY", 2025)]
    assert one(X.boilerplate_signature("l"), l="Apple Inc. | 2024 Form 10-K | 25") == "apple inc. | 2024 form 10-k | #"
    assert one(X.boilerplate_signature("l"), l="Revenue grew") is None
    assert one(X.normal_line("l"), l=" a \t b ") == "a b"
    assert one(X.heading_signature("h"), h="Risk  Factors (continued)") == "risk factors"
    assert one(X.reference_stub("s"), s="Incorporated by reference") is True
    assert one(X.elapsed_ms("n"), n=1_500_000) == 2 and one(X.elapsed_ms("n"), n=1) == 1


def test_fused_queries_search_and_ask_all_documents(spark, tmp_path):
    from ledgerline.plans.queries import QUERIES

    docs = [(i, f"common word{i % 5}", "en", "src", 10) for i in range(1990, 2110)]
    spark.createDataFrame(
        docs, "doc_id long, text string, lang string, source string, n_chars int"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(
        [(i, [1.0, float(i)]) for i in range(3)], "vec_id long, embedding array<float>"
    ).write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("hybrid_rrf_topk", "capped_rrf"):
        rows = QUERIES[name](spark, str(tmp_path)).collect()
        assert {r.qid for r in rows} == {0, 2000, 2100}
        assert max(r.id for r in rows if r.qid == 2000) >= 2000


def test_relaxation_is_for_each_question_alone(spark):
    rows = [(1, "T", 2020, "FY", [1.0, 0.0]), (2, "T", 2021, "FY", [0.0, 1.0]), (3, "U", 2020, "FY", [1.0, 1.0])]
    chunks = spark.createDataFrame(
        rows, "id long, ticker string, fiscal_year int, fiscal_period string, embedding array<double>"
    ).withColumn("text", F.lit("x")).withColumn("section", F.lit("Notes"))
    asked = spark.createDataFrame(
        [(1, "x", [1.0, 0.0]), (2, "x", [1.0, 0.5])], "qid int, query string, embedding array<double>"
    )
    found = lambda filters: sorted((r.qid, r.id) for r in retrieval.retrieve(asked, chunks, filters, strategy="vector", relax=True, n=3).collect())
    assert found({"fiscal_year": 2020, "ticker": "T"}) == [(1, 1), (2, 1)]
    assert found({"fiscal_year": 1999, "ticker": "T"}) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    # one question finds something and keeps the filter, the other does not: 30 text rows for a hybrid search
    words = chunks.withColumn("text", F.when(F.col("id") == 2, "late").otherwise("early"))
    none = asked.select("qid", F.when(F.col("qid") == 1, "late").otherwise("early").alias("query"))
    text = retrieval.text_search(none, words, 5, {"fiscal_year": 2020})
    assert sorted((r.qid, r.id) for r in text.collect()) == [(2, 1), (2, 3)]


def test_text_search_in_blocks_equals_one_block(spark):
    chunks = spark.createDataFrame(
        [(k, " ".join(f"w{(k * j) % 7}" for j in range(1, 6))) for k in range(40)] + [(90, None), (91, "")],
        "id long, text string"
    )
    asked = spark.createDataFrame(
        [(k, f"w{k} w{k + 1} the") for k in range(6)] + [(50, "the of"), (51, None)], "qid int, query string"
    )
    rows = lambda **x: sorted(map(tuple, retrieval.text_search(asked, chunks.repartition(3), 4, **x).collect()))
    assert rows(block=2) == rows() and {r[0] for r in rows()} == set(range(6))
    counts = {r.qid: r.matches for r in retrieval.text_match_counts(asked, chunks, block=3).collect()}
    assert counts[50] == counts[51] == 0 and counts[0] == sum(
        bool({f"w{(k * j) % 7}" for j in range(1, 6)} & {"w0", "w1"}) for k in range(40)
    )
    for k in (0, -1, True, 1.5):
        with pytest.raises(ValueError):
            retrieval.text_search(asked, chunks, k)


def test_citations_meet_one_chunk_each(spark):
    chunks = spark.createDataFrame(
        [(k, f"u{k % 2}", ("A", "B", None)[k % 3], f"acc{k % 4}") for k in range(24)],
        "id long, source_url string, section string, accession_no string"
    )
    cites = [
        (n, u, s, a) for n,
        (u, s, a) in enumerate((u, s, a) for u in ("u0", "u1", "none", None) for s in ("A", "B", None, "C") for a in ("acc1", "acc2", None))
    ]
    got = {
        r.cid: (r.valid, r.section, r.accession_no) for r in evaluation.resolved_citations(spark.createDataFrame(cites, "cid long, source_url string, section string, accession_no string"), chunks).collect()
    }
    rows = [tuple(r) for r in chunks.collect()]
    for n, u, s, a in cites:
        fit = min((r for r in rows if r[1] == u and s in (None, r[2]) and a in (None, r[3])), default=None)
        assert got[n] == ((True, fit[2], fit[3]) if fit else (False, None, None))


def test_headings_compare_in_one_form(spark):
    cases = {
        "Risk  Factors (continued)": "risk factors", "We continued operations": "we continued operations",
        "Continued": "continued", "Management’s Report — 10‑K.": "management's report - 10 - k",
        "Notes (Continued) to A": "notes (continued) to a"
    }
    rows = spark.createDataFrame([(k,) for k in cases], "h string").select(
        "h", X.heading_signature("h").alias("k")
    ).collect()
    assert {r.h: r.k for r in rows} == cases == {k: X.heading_key(k) for k in cases}
    lines = ["Form 10-K | 2024 | Page 7 of 9", "Page 12", "a | 3", "plain", "form 10-q", "x" * 190 + " | 3"]
    rows = spark.createDataFrame([(k,) for k in lines], "h string").select(
        "h", X.boilerplate_signature("h").alias("k")
    ).collect()
    assert {r.h: r.k for r in rows} == {k: X.footer_key(k) for k in lines}


def test_the_best_of_many_parts_are_those_of_all():
    import numpy as np

    rng = np.random.default_rng(3)
    ids, scores = rng.permutation(3000), rng.integers(0, 6, (3000, 7)).astype(np.float32)
    scores[:, 5], scores[4:, 6] = 0, 0
    best = retrieval.Best(list("abcdefg"), 9, 0)
    for at in range(0, 3000, 170):
        best.add(ids[at : at + 170], scores[at : at + 170])
        assert len(best.held[0]) <= 7 * 9
    got = best.rows(retrieval.pa.string(), "n").to_pylist()
    want = [{"qid": q, "id": i, "n": n} for c, q in enumerate("abcdefg") for n, i in sorted(zip(scores[:, c], ids), key=lambda x: (-x[0], x[1]))[:9] if n > 0]
    assert got == want


def test_frequent_and_rare_terms_count_alike():
    import numpy as np

    rng = np.random.default_rng(5)
    word = lambda: f"w{int(rng.zipf(1.4)) % 400}"
    asked = [(q, [word() for _ in range(30)]) for q in range(60)] + [(60, []), (61, None)]
    texts = [[word() for _ in range(rng.integers(0, 80))] for _ in range(50)] + [None, []]
    index = retrieval._TermIndex(asked)
    assert 0 < index.often < len(index.ids)
    term, begin = index.coded(retrieval.pa.array(texts, retrieval.pa.list_(retrieval.pa.string())))
    want = [[sum(w in set(q or []) for w in t or []) for _, q in asked] for t in texts]
    assert index.counts(term, begin).tolist() == want
    assert index.counts(term, begin[20:31]).tolist() == want[20:30]
