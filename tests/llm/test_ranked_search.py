"""The clustered index against the SQL and against scores of all documents."""

import duckdb
import numpy as np
import pytest

from ledgerline.llm import bisection, queries, ranked_search


def words(rng, topic, n):
    return " ".join(f"t{topic}x{int(w)}" if rng.random() < 0.7 else f"w{int(w) % 20}" for w in rng.zipf(1.4, n) % 300)


def documents(n=900):
    rng = np.random.default_rng(3)
    rows = [(k, words(rng, k % 7, int(rng.integers(3, 90)))) for k in range(n)]
    hot = words(rng, 9, 60)
    rows += [(n + k, hot) for k in range(n // 2)]  # a third of all are copies
    rows += [(None, hot), (5, hot), (5, hot), (7000, None), (7001, ""), (7002, "?! _-"), (7003, "ÉTÉ été İstanbul x" + " big" * 40_000), (None, None)]
    return rows


ITEMS = [
    (0, "w1 w2 t3x1 t3x2 T3X3"), (1, "t9x1 t9x2 t9x3 w5"), (2, "été Été BIG big"), (3, None), (4, "..."), (5, "nowhere at all"), (6, "t0x1 t1x1 t2x1 t3x1 t4x1 t5x1"),
    (7, "w3 w3 w3"), (7, "t1x5"), (None, "w4 t2x2"), (None, "t2x2"),
]


def tables(spark, folder, rows, items):
    docs = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], "doc_id long, text string, term string, shard int, score int").repartition(4)
    asked = spark.createDataFrame([(*r, 1, "i") for r in items], "item_id long, text string, weight int, item string").repartition(2)
    docs.write.parquet(f"{folder}/documents.parquet")
    asked.write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")


def expected(folder):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return sorted(con.sql(f"SELECT item_id, rank, doc_id, score FROM ({queries.OP12_SQL}) q").fetchall(), key=repr)


def rows_of(found):
    return sorted(((r.item, r.rank, r.id, r.score) for r in found.collect()), key=repr)


@pytest.mark.parametrize("shard_docs, first, together", [(2048, 2, 1000), (90, 1, 2), (30, 2, 1000)])
def test_rows_equal_the_sql(spark, tmp_path, monkeypatch, shard_docs, first, together):
    for name, value in (("FIRST", first), ("TOGETHER", together)):
        monkeypatch.setattr(ranked_search, name, value)
    docs, items = tables(spark, tmp_path, documents(), ITEMS)
    index = ranked_search.build(docs, shard_docs=shard_docs)
    want = expected(tmp_path)
    assert rows_of(ranked_search.search(index, items, 20)) == want
    assert {r[0] for r in want} == {0, 1, 2, 6, 7, None}
    if shard_docs == 2048:
        got = queries.op12_ranked_search(spark, str(tmp_path)).select("item_id", "rank", "doc_id", "score")
        assert sorted(map(tuple, got.collect()), key=repr) == want
    else:
        assert index.ranks.count() > 5


def test_empty_tables(spark, tmp_path):
    docs, items = tables(spark, tmp_path, [(1, None)], ITEMS)
    assert ranked_search.search(ranked_search.build(docs.limit(0)), items).collect() == []
    assert ranked_search.search(ranked_search.build(docs), items).collect() == []
    one = spark.createDataFrame([(1, "w1")], "doc_id long, text string")
    assert ranked_search.search(ranked_search.build(one), items.limit(0)).collect() == []
    assert [r.id for r in ranked_search.search(ranked_search.build(one), items).collect() if r.item == 0] == [1]


def test_visits_are_stopped_by_bounds(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(k, words(rng, k % 16, 60)) for k in range(3200)]
    docs, items = tables(spark, tmp_path, rows, [(t, f"t{t}x1 t{t}x2 t{t}x3 t{t}x4 t{t}x5") for t in range(16)])
    index = ranked_search.build(docs, shard_docs=100)
    assert rows_of(ranked_search.search(index, items, 5)) == [r for r in expected(tmp_path) if r[1] <= 5]
    ours = index.lists.where("n >= 10").select("shard").distinct().count()
    assert ours > 16


def test_bisection_brings_topics_together():
    rng = np.random.default_rng(1)
    topics = rng.permutation(np.repeat(np.arange(8), 40))
    docs = [np.unique(rng.integers(0, 200, 30) + 1000 * t).astype(np.uint16) for t in topics]
    begins = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    order = bisection.ordered(begins, np.concatenate(docs), 20)
    assert sorted(order) == list(range(320))
    same = (np.diff(topics[order]) == 0).mean()
    assert same > 0.85 > (np.diff(topics) == 0).mean() + 0.5
    tree = bisection.Tree(docs, 3)
    leaves = tree.leaves(begins, np.concatenate(docs))
    assert set(leaves) <= set(range(8))
    pure = np.mean([np.bincount(leaves[topics == t]).max() / 40 for t in range(8)])
    assert pure > 0.8


def test_bisection_of_copies_and_single_documents():
    docs = [np.array([1, 2, 3], np.uint16)] * 9
    begins = np.arange(0, 28, 3)
    assert sorted(bisection.ordered(begins, np.concatenate(docs), 2)) == list(range(9))
    assert list(bisection.Tree([], 2).leaves(begins, np.concatenate(docs))) == [0] * 9
    assert list(bisection.Tree(docs[:1], 0).leaves(begins[:2], docs[0])) == [0]


@pytest.mark.parametrize("text, want", [("Ab-c1 É_é", ["ab", "c1", "É", "é"]), ("", []), ("\x00\x7f[]{}`@", []), ("ﬁ İ", ["ﬁ", "İ"])])
def test_terms(text, want):
    assert [t.decode() for t in ranked_search.terms(text.encode())] == want
