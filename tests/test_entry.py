import decimal
import importlib
import sys

import pytest

import __spark_entry__ as entry
from ledgerline.plans import queries as plans


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_is_of_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_corpus_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("ledgerline.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("ledgerline.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name="ledgerline.llm" if "llm" in name else name)

    import ledgerline

    monkeypatch.delattr(ledgerline, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    bare = importlib.reload(entry)
    assert "fact_yoy_change" in bare.queries() and not any(
        n.startswith("op") for n in bare.queries()
    ) and "pipeline" not in bare.queries()
    monkeypatch.undo()
    importlib.reload(entry)


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """Numbers to six digits, whatever their kind."""
    if isinstance(value, bool) or not isinstance(value, (int, float, decimal.Decimal)):
        return value
    return round(float(value), 6)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_queries_equal_duckdb(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    same = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=repr)
    found = entry.queries()[name](spark, sf)
    assert sorted(found.columns) == sorted(names)
    assert same(found.select(*names).collect()) == same(want.fetchall())
