"""URL verdicts against the SQL, on links, classes and awkward rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import queries, url_aliases

CANONICAL = '<html><head><link rel="{}" href="{}"></head></html>'
REFRESH = "<html><META HTTP-EQUIV='Refresh' content='0; URL={}'></html>"
BLOCKED = "http://a.example.org/es/1"
PAGES = [
    (0, BLOCKED, "<p>no links</p>"),
    (1, "https://x.net/1", CANONICAL.format("canonical", BLOCKED)),
    (2, "https://x.net/2#part", REFRESH.format("https://X.net/1#top")),
    (3, "https://x.net/2", None),
    (4, "http://b.example.org/fr/1", CANONICAL.format("nofollow canonical", "https://x.net/2")),
    (5, "https://y.net/3", f"<!-- {CANONICAL.format('canonical', BLOCKED)} --><script>'{CANONICAL.format('canonical', BLOCKED)}'</script>"),
    (6, "https://y.net/4", CANONICAL.format("stylesheet", BLOCKED)),
    (7, "https://y.net/5", CANONICAL.format("canonical", "//z.com/de/only-linked")),
    (8, "https://y.net/dir/6?q=1", CANONICAL.format("canonical", "seven?a=1&amp;b=2")),
    (9, "https://y.net/dir/seven?a=1&b=2", CANONICAL.format("canonical", "/root")),
    (10, "https://y.net/root", CANONICAL.format("canonical", "http://a.org.example.org/en/19")),
    (11, "https://y.net/mail", CANONICAL.format("canonical", "mailto:a@example.org")),
    (12, None, CANONICAL.format("canonical", BLOCKED)), (13, "", ""), (14, "not a url", CANONICAL.format("canonical", BLOCKED)),
    (15, "HTTP://EXAMPLE.ORG/en/1", ""), (16, "http://example.org/EN/1", ""), (17, "http://badexample.org/es/", ""),
    (18, "http://org", ""), (19, "http://org/", ""), (20, "http://example.org?x=/es/", ""), (21, "http://é.com/de/é#x", ""),
    (22, "a://b://c.com/de/", ""), (23, "http://example.org.com/fr/x", ""), (24, "http://example.org:80/es/", ""),
    (None, BLOCKED, ""), (0, BLOCKED, "<p>no links</p>"), (25, "http://com/de/" + "x" * 200_000, "<p>" * 100_000),
    (26, "https://self.net/", CANONICAL.format("canonical", "#top")), (27, "http://" + "a." * 3000 + "com/fr/", ""),
]


def table(spark, rows):
    kind = "page_id long, url string, html string, verdict int, host string, rule string, allows string"
    return spark.createDataFrame([(*r, 1, "h", "r", "a") for r in rows], kind).repartition(3)


def key(rows):
    return sorted(map(repr, rows))


def judged(spark, rows, **more):
    return url_aliases.judge(table(spark, rows), spark.sql(f"SELECT * FROM {queries.URL_RULES}"), **more)


def test_verdicts_equal_the_sql(spark, tmp_path):
    table(spark, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op11_url_aliases(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({queries.OP11_SQL}) q").fetchall()
    assert key(map(tuple, got)) == key(want)
    by = {r.page_id: r for r in got}
    assert {k: by[k].verdict for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 26)} == {
        1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "block", 9: "block", 10: "block", 11: "allow", 26: "allow"
    }
    assert (by[4].rule, by[1].rule, by[12].host, by[12].verdict) == ("org/", None, "", "allow")


def test_no_rows(spark):
    assert judged(spark, []).collect() == []
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert [r.verdict for r in url_aliases.judge(table(spark, PAGES[:2]), none).collect()] == ["allow", "allow"]


def test_a_chain_and_a_hub(spark):
    chain = [(k, f"http://c.net/{k}", CANONICAL.format("canonical", f"http://c.net/{k + 1}")) for k in range(40)]
    hub = [(100 + k, f"http://h{k}.net/", REFRESH.format(BLOCKED)) for k in range(300)]
    free = [(500 + k, f"http://f{k}.net/", REFRESH.format("http://free.net/")) for k in range(300)]
    redirects = spark.createDataFrame([("http://c.net/40", BLOCKED), (None, BLOCKED), ("http://f1.net/", None)], "url string, target string")
    got = {r.page_id: r.verdict for r in judged(spark, chain + hub + free, redirects=redirects).collect()}
    assert {v for k, v in got.items() if k < 500} == {"block"} and len(got) == 640
    assert {v for k, v in got.items() if k >= 500} == {"allow"}
    alone = judged(spark, chain, redirects=redirects, html_col=None).collect()
    assert {r.verdict for r in alone} == {"allow"}


@pytest.mark.parametrize("href, want", [
    ("../a/./b", "http://s.net/x/a/b"), ("..", "http://s.net/x/"), ("../../../up?q=..", "http://s.net/up?q=.."), ("./", "http://s.net/x/y/"),
    ("?p=2", "http://s.net/x/y/z?p=2"), (" \n/a ", "http://s.net/a"), ("HTTPS://T.net", "HTTPS://T.net"), ("javascript:void(0)", None), ("", None),
])
def test_links_are_resolved(spark, href, want):
    row = spark.createDataFrame([("http://s.net/x/y/z?old=1#f", href)], "base string, href string")
    assert row.select(url_aliases.resolved(F.col("base"), F.col("href")).alias("r")).first().r == want


def test_ties_and_wrong_rules(spark):
    rules = spark.createDataFrame(
        [("block", "A.net", "/x"), ("allow", "a.net", "/x"), ("block", "net", None), ("block", "a.net", "/x/y")], "verdict string, host string, path string"
    )
    pages = table(spark, [(1, "http://a.net/x", ""), (2, "http://a.net/x/y/z", ""), (3, "http://b.net", ""), (4, "http://b.com/", "")])
    got = {r.page_id: (r.rule, r.verdict) for r in url_aliases.judge(pages, rules).collect()}
    assert got == {1: ("a.net/x", "allow"), 2: ("a.net/x/y", "block"), 3: ("net", "block"), 4: (None, "allow")}
    with pytest.raises(Exception, match="allows or blocks"):
        url_aliases.judge(pages, spark.createDataFrame([("maybe", "a", "/")], "verdict string, host string, path string")).collect()


def test_runs_no_python(spark):
    plan = judged(spark, PAGES)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
