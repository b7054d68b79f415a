"""Keyed state against the batch load, and requests that are dealt to tasks."""

import datetime
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import facts
from ledgerline.sources import commits, landing
from ledgerline.sources.fetch import landed_name
from ledgerline.streaming import ledger

KIND = "source string, cik long, metric string, fiscal_year int, fiscal_period string, unit string, value double, filing_date date, accession_no string"


def filed(k):
    rng = random.Random(k)
    cik, metric = rng.choice([1, 1, 1, 2, 3]), rng.choice(["revenue", "net_income"])
    day = datetime.date(2020, 1, 1) + datetime.timedelta(days=rng.randrange(900))
    return ("xbrl", cik, metric, 2018 + rng.randrange(3), rng.choice(["FY", "Q1"]), "USD", float(k), day, f"acc{k:05d}")


def streamed(spark, tmp_path, batches, name):
    folder = tmp_path / f"{name}-in"
    table, state = str(tmp_path / f"{name}-table"), str(tmp_path / f"{name}-state")
    for rows in batches:
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(str(folder))
        ledger.follow(spark, str(folder), KIND, table, state).awaitTermination()
    return table


def content(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_an_out_of_order_replay_equals_the_batch_load(spark, tmp_path):
    rows = [filed(k) for k in range(120)]
    columns = KIND.replace(" string", "").replace(" long", "").replace(" int", "").replace(" double", "").replace(" date", "").split(", ")
    whole = spark.createDataFrame(rows, KIND)
    want = content(facts.latest_restatement(whole), *columns)
    shuffled = random.Random(1).sample(rows, len(rows))
    table = streamed(spark, tmp_path, [shuffled[:50], shuffled[50:51], shuffled[51:]], "shuffled")
    assert content(ledger.facts_now(spark, table, KIND), *columns) == want
    cursor = spark.createDataFrame([], "cik long, last_filing_date date, last_accession string")
    moved = content(facts.advance_cursor(cursor, whole), "cik", "last_filing_date", "last_accession")
    assert content(ledger.cursors_now(spark, table, KIND), "cik", "last_filing_date", "last_accession") == moved
    changes = commits.read(spark, table, f"kind string, replaces string, {KIND}, batch long")
    assert changes.where("replaces IS NOT NULL").count() > 0 and changes.where("kind = 'fact'").count() < len(rows)
    before = commits.snapshot(spark, table).version
    assert ledger.compact(spark, table, KIND) == before + 1
    assert content(ledger.facts_now(spark, table, KIND), *columns) == want
    assert content(ledger.cursors_now(spark, table, KIND), "cik", "last_filing_date", "last_accession") == moved
    assert commits.read(spark, table, f"kind string, replaces string, {KIND}, batch long").where("kind = 'fact'").count() == len(want)


def test_late_and_corrected_facts(spark, tmp_path):
    day = lambda d: datetime.date(2024, 1, d)
    one = lambda value, d, acc: ("xbrl", 1, "revenue", 2023, "FY", "USD", value, day(d), acc)
    table = streamed(spark, tmp_path, [[one(1.0, 5, "b")], [one(9.0, 2, "a")], [one(2.0, 5, "b")], [one(3.0, 7, "c"), one(4.0, 6, "x")]], "late")
    log = commits.read(spark, table, f"kind string, replaces string, {KIND}, batch long").where("kind = 'fact'").orderBy("batch")
    assert [(r.value, r.replaces) for r in log.collect()] == [(1.0, None), (2.0, "b"), (3.0, "b")]
    assert content(ledger.facts_now(spark, table, KIND), "value") == [(3.0,)]


def test_a_batch_is_joined_by_spark_alone_and_may_run_again(spark):
    day = lambda d: datetime.date(2024, 1, d)
    one = lambda period, value, d, acc: ("xbrl", 1, "revenue", 2023, period, "USD", value, day(d), acc)
    log = spark.createDataFrame(
        [("fact", None, *one(None, 1.0, 5, "b")), ("cursor", None, "xbrl", 1, "revenue", None, None, None, None, day(5), "b")], f"kind string, replaces string, {KIND}"
    )
    batch = spark.createDataFrame([one(None, 2.0, 6, "c"), one(None, 3.0, 4, "a"), one("FY", 4.0, 4, "a")], KIND)
    found = ledger.changes(batch, log)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    for _ in range(2):
        got = sorted(((r.kind, r.replaces, r.fiscal_period, r.value, r.accession_no) for r in found.collect()), key=repr)
        assert got == [("cursor", None, None, None, "c"), ("fact", "b", None, 2.0, "c"), ("fact", None, "FY", 4.0, "a")]


SEEN: list = []
LOCK = threading.Lock()


def answers(url):
    """A service that is busy once for each second address and has no page 404."""
    with LOCK:
        SEEN.append((url, time.monotonic()))
        again = sum(u == url for u, _ in SEEN)
    if url.endswith("404"):
        return 404, {}, b""
    if url.endswith("2") and again == 1:
        return 429, {"Retry-After": "0"}, b""
    return 200, {}, f"body of {url}".encode()


URLS = [f"https://data.sec.gov/{k}" for k in range(6)]


def test_what_is_missing_is_landed_by_tasks(spark, tmp_path):
    path, asked = str(tmp_path / "landed"), spark.sparkContext.accumulator(0)

    def transport(url, busy={}):  # noqa: B006
        asked.add(1)
        busy[url] = busy.get(url, 0) + 1
        return (404, {}, b"") if url.endswith("404") else (429, {"Retry-After": "0"}, b"") if url.endswith("2") and busy[url] == 1 else (200, {}, url.encode())

    urls = spark.createDataFrame([(u, 1) for u in [*URLS[:4], URLS[0], "https://data.sec.gov/404", "http://elsewhere.org/x", None]], "url string, name int")
    rate = landing.Rate(per_second=10.0, tasks=2)
    failed = {r.url: r.error for r in landing.land(urls, path, transport, rate).collect()}
    assert set(failed) == {"https://data.sec.gov/404", "http://elsewhere.org/x"} and "404" in failed["https://data.sec.gov/404"]
    assert {r.name: bytes(r.body).decode() for r in landing.landed(spark, path).collect()} == {landed_name(u): u for u in URLS[:4]}
    assert asked.value == 6  # four pages, one of them twice, and one that is not there
    assert landing.land(urls.where(F.col("url").isin(URLS)), path, transport, rate).count() == 0 and asked.value == 6
    landing.land(spark.createDataFrame([(u,) for u in URLS], "url string"), path, transport, rate)
    assert asked.value == 8 and landing.landed(spark, path).count() == 6 and commits.snapshot(spark, path).version == 2


def test_a_data_source_of_responses(spark):
    spark.dataSource.register(landing.Responses)
    reader = spark.read.format("filing_responses").option("transport", "tests.test_ledger_and_landing:answers").option("tasks", "2").option("per_second", "10")
    rows = reader.option("urls", "\n".join([*URLS, "https://data.sec.gov/404", URLS[0], ""])).load().collect()
    assert {r.url: r.body and bytes(r.body).decode() for r in rows} == {u: f"body of {u}" for u in URLS} | {"https://data.sec.gov/404": None}
    assert len(rows) == 7 and all((r.error is None) == (r.body is not None) and r.name == landed_name(r.url) for r in rows)
    with pytest.raises(Exception, match="not of the service"):
        reader.option("urls", "https://example.org/x").load().collect()


def test_tasks_share_the_rate():
    waits = []
    fetcher = landing.Rate(per_second=8.0, tasks=4).fetcher(lambda url: (200, {}, b"x"), waits.append)
    assert [landing.landed_name(u) for u in URLS] == [n for n, *_ in landing._rows(URLS, fetcher)]
    assert fetcher.pace.gap == 0.5 and len(waits) == 5 and sum(waits) > 5 * 0.5 - 0.1
    part = landing._Reader({"transport": "m:f", "urls": "\n".join([*URLS, URLS[0]]), "tasks": "4"}).partitions()
    assert sorted(u for p in part for u in p.urls) == sorted(URLS) and len(part) == 4
