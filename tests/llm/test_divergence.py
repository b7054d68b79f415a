"""Divergences of sources against the SQL, exact arithmetic and awkward rows."""

import duckdb
import numpy as np
import pytest

from ledgerline.llm import divergence, queries


def documents():
    rng = np.random.default_rng(11)
    rows = []
    for k in range(420):
        lang, source = ("en", "de", None)[k % 3], f"s{k * k % 9}"
        vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in ("x", "Y", "é")]
        text = " ".join(vocabulary[int(x) % 24] for x in rng.zipf(1.3 + 0.1 * (k % 9), rng.integers(0, 40)))
        rows.append((k, text, lang, source))
    rows += [(1000 + k, "same copy of a text", "en", "hot") for k in range(200)]
    rows += [(k, None, "en", "silent") for k in range(3)] + [(None, "", "fr", None), (None, "un deux", "fr", "b"), (7, "1 2 3", "fr", "é"), (7, "1 2 3", "fr", "z")]
    rows += [(2000, "long " * 60_000 + "ax", "de", ""), (2001, "İstanbul ﬁ AX'ax_ax1ax", "de", "s1")]
    return rows


def table(spark, rows, parts=5):
    return spark.createDataFrame([(*r, 1, "t", 2) for r in rows], "doc_id long, text string, lang string, source string, n long, term string, block int").repartition(parts)


def expected(folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return sorted(con.sql(f"SELECT lang, source, part, item, value, rank FROM ({queries.OP13_SQL}) q").fetchall())


@pytest.mark.parametrize("terms, sources, held", [(1024, 64, 400_000), (3, 2, 5), (7, 1, 50)])
def test_rows_equal_the_sql(spark, tmp_path, monkeypatch, terms, sources, held):
    for name, value in (("TERMS", terms), ("SOURCES", sources), ("HELD", held)):
        monkeypatch.setattr(divergence, name, value)
    table(spark, documents()).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_source_divergence(spark, str(tmp_path)).select("lang", "source", "part", "item", "value", "rank")
    want = expected(tmp_path)
    assert sorted(map(tuple, got.collect())) == want
    assert {r[0] for r in want} == {"", "en", "de", "fr"} and {r[2] for r in want} == {"pair", "term"}
    assert all(r[4] == 0 for r in want if r[0] == "fr")


def test_empty_and_single_sources(spark):
    assert divergence.audit(table(spark, [])).collect() == []
    assert divergence.audit(table(spark, [(k, "a b", "en", "one") for k in range(12)])).collect() == []
    pair = divergence.audit(table(spark, [(1, None, None, None), (2, "a", None, "x")])).collect()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in pair) == [("", "", "pair", "x", 0, 1), ("", "x", "pair", "", 0, 1)]


def test_shares_are_exact_beyond_64_bits():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 2**49, 500)
    whole = counts.sum() + 2 * 500
    want = [1 + 10**9 * (int(c) + 2) // int(whole) for c in counts]
    assert divergence.shares(counts, np.array([whole])).tolist() == want
    p, q = np.array([10**9 + 1, 1, 7]), np.array([1, 10**9 + 1, 7])
    assert divergence.distance(p, q).tolist() == [10**18 // (10**9 + 2)] * 2 + [0]
