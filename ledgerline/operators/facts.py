"""Canonical financial facts: candidates from nested JSON, context selection, restatements, loads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocabulary as V

RECORD = "struct<val:decimal(38,6),accn:string,fy:string,fp:string,start:string,end:string,filed:string,form:string>"
TAG_FACTS = f"struct<units:struct<{','.join(f'{u}:array<{RECORD}>' for u in V.UNITS)}>>"
#: Only mapped tags and known units: the parser passes over all others.
COMPANY_FACTS = f"cik string, facts map<string, struct<{','.join(f'{t}:{TAG_FACTS}' for tags in V.METRIC_TAGS.values() for t in tags)}>>"
FACT_KEY = ["cik", "metric", "fiscal_year", "fiscal_period"]
STORED_KEY = [*FACT_KEY, "taxonomy_tag", "filing_date"]


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group in a total order; Spark limits groups before the shuffle."""
    return df.withColumn(
        "__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ).where("__rank = 1").drop("__rank")


def mapped_tags() -> list[tuple[str, str, int]]:
    """(taxonomy_tag, metric, tag_priority); a tag of two metrics is an error."""
    rows = [(tag, metric, i) for metric, tags in V.METRIC_TAGS.items() for i, tag in enumerate(tags)]
    if len({r[0] for r in rows}) != len(rows):
        raise ValueError("a tag stands for two metrics")
    return rows


def _date(name: str) -> Column:
    text = F.nullif(F.trim(name), F.lit(""))
    return F.when(text.rlike(r"^(?!0000)\d{4}-\d{2}-\d{2}\z"), text.try_cast("date"))


def filing_index_url(cik: str, accession: str) -> Column:
    plain = F.regexp_replace(accession, "-", "")
    return F.concat(
        F.lit("https://www.sec.gov/Archives/edgar/data/"), F.col(cik).cast("string"), F.lit("/"), plain, F.lit("/"),
        F.col(accession), F.lit("-index.html")
    )


def judged_candidates(payloads: DataFrame, companies: DataFrame) -> DataFrame:
    """Rows of every mapped tag of ``payloads`` (cik, json) for ``companies`` (cik, ticker, name), with ``reject_reason``, null if valid.

    Unmapped tags, other units, forms and periods are left out; malformed records
    of mapped tags are rejected. A payload must be of the company it is filed under.
    """
    parsed = payloads.select("cik", F.from_json("json", COMPANY_FACTS).alias("doc")).join(companies, "cik")
    same = F.try_to_number(F.col("doc.cik"), F.lit("9999999999")).cast("long")
    parsed = parsed.withColumn("__mismatch", F.coalesce(same != F.col("cik"), F.lit(True)))
    head = ["cik", "ticker", "name", "__mismatch"]
    # an inner explode would have Spark filter payloads by their parsed facts first, which parses each twice
    tags = parsed.select(*head, F.explode_outer("doc.facts").alias("taxonomy", "tags")).where("tags IS NOT NULL")
    lists = [
        F.struct(F.lit(t).alias("taxonomy_tag"), F.lit(m).alias("metric"), F.lit(i).alias("tag_priority"), F.lit(u).alias("unit"), F.col(f"tags.{t}.units.{u}").alias("records"))
        for t, m, i in mapped_tags() for u in V.UNITS
    ]
    units = tags.select(*head, F.explode(F.array(*lists)).alias("of"))
    records = units.select(*head, "of.*").select("*", F.explode("records").alias("r")).drop("records")
    form = F.create_map(*[F.lit(x) for pair in V.FORMS.items() for x in pair])[F.col("r.form")]
    rows = records.where(F.col("r.form").isin(*V.FORMS) & F.col("r.fp").isin(*V.PERIODS)).select(
        "cik", "ticker", F.col("name").alias("company_name"), "metric", "taxonomy_tag", "tag_priority", "unit", "__mismatch",
        F.expr("try_cast(r.fy AS int)").alias("fiscal_year"), F.col("r.fp").alias("fiscal_period"),
        _date("r.start").alias("period_start"), F.col("r.start").alias("__start"), _date("r.end").alias("period_end"),
        F.col("r.val").alias("value"), form.alias("form_type"), _date("r.filed").alias("filing_date"), F.col("r.accn").alias("accession_no"),
    )
    rows = rows.where((F.col("form_type") == "10-K") == (F.col("fiscal_period") == "FY"))
    duration = F.col("metric").isin(*V.DURATION_METRICS)
    reasons = [
        (F.col("__mismatch"), "payload_of_another_company"),
        (~F.coalesce(F.col("fiscal_year") > 0, F.lit(False)), "fiscal_year"),
        (F.col("filing_date").isNull(), "filing_date"),
        (F.col("period_end").isNull(), "period_end"),
        (F.col("__start").isNotNull() & (F.trim("__start") != "") & F.col("period_start").isNull(), "period_start"),
        (duration & F.col("period_start").isNull(), "duration_without_start"),
        (~duration & F.col("period_start").isNotNull(), "instant_with_start"),
        (F.col("period_start") > F.col("period_end"), "start_after_end"),
        (F.col("value").isNull(), "value"),
        (~F.coalesce(F.col("accession_no").rlike(V.ACCESSION), F.lit(False)), "accession_no"),
    ]
    reason = reduce(
        lambda rest, x: F.when(x[0], F.lit(x[1])).otherwise(rest), reversed(reasons), F.lit(None).cast("string")
    )
    return rows.withColumn("reject_reason", reason).withColumn(
        "source_url", filing_index_url("cik", "accession_no")
    ).drop("__start", "__mismatch")


def fact_candidates(payloads: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reason) rows of :func:`judged_candidates`; each of both parses the payloads."""
    judged = judged_candidates(payloads, companies)
    return judged.where("reject_reason IS NULL").drop("reject_reason"), judged.where("reject_reason IS NOT NULL")


def primary_context(candidates: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """One fact per filing, metric and period: the latest end; of durations the longest for a year, the shortest for a quarter; then the preferred tag.

    Ties go to the tag's name, then to the value as text. One window sort serves all steps. ``also`` names columns that the
    filing fixes: with them as keys, rows that are already together by them are not shuffled.
    """
    start = F.datediff("period_start", F.lit("1970-01-01").cast("date"))
    length = F.when(
        ~F.col("metric").isin(*V.DURATION_METRICS), 0
    ).when(F.col("fiscal_period") == "FY", start).otherwise(-start)
    return first_by(
        candidates, [*also, "accession_no", "metric", "fiscal_year", "fiscal_period"], F.desc("period_end"),
        length.asc_nulls_last(), F.asc("tag_priority"), F.asc("taxonomy_tag"),
        F.col("value").cast("decimal(28,4)").cast("string")
    )


def latest_restatement(facts: DataFrame) -> DataFrame:
    """Per company, metric and period the fact that was filed last."""
    return first_by(facts, FACT_KEY, F.desc("filing_date"), F.desc("accession_no"))


def latest_facts(candidates: DataFrame) -> DataFrame:
    """The last restatement of each filing's primary facts. A filing has one company, so one shuffle by company, metric and period serves both windows."""
    return latest_restatement(primary_context(candidates.repartition(*FACT_KEY), ("cik",)))


def latest_stored(facts: DataFrame, id_col: str) -> DataFrame:
    """One stored fact per ticker, metric, period and unit: the last filed, then the largest id."""
    return first_by(
        facts, ["ticker", "metric", "fiscal_year", "fiscal_period", "unit"], F.col("filing_date").desc_nulls_last(),
        F.desc(id_col)
    )


def canonical_order(facts: DataFrame) -> DataFrame:
    return facts.orderBy(
        "fiscal_year", F.array_position(F.array(*map(F.lit, V.PERIODS)), F.col("fiscal_period")), "metric", "ticker"
    )


def after_cursor(facts: DataFrame, cursor: DataFrame) -> DataFrame:
    """Facts filed strictly after their company's cursor (cik, last_filing_date); a filing of the cursor's own day is skipped."""
    return facts.join(cursor, "cik", "left").where(
        F.col("last_filing_date").isNull() | (F.col("filing_date") > F.col("last_filing_date"))
    ).drop("last_filing_date")


def not_older_than_stored(facts: DataFrame, stored: DataFrame) -> DataFrame:
    """Facts for whose key no later filing is stored."""
    newest = stored.groupBy(*FACT_KEY).agg(F.max("filing_date").alias("__newest"))
    return facts.join(newest, FACT_KEY, "left").where(
        F.col("__newest").isNull() | (F.col("__newest") <= F.col("filing_date"))
    ).drop("__newest")


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """Stored rows whose key is not incoming, and of the incoming rows the first of each key."""
    winners = first_by(incoming, key, *order) if order else incoming.dropDuplicates(key)
    return stored.join(winners.select(*key), key, "left_anti").unionByName(winners.select(*stored.columns))


def drop_superseded(facts: DataFrame) -> DataFrame:
    """Facts without those of an older filing, or of another tag on the same date, for the same canonical key."""
    return latest_restatement(facts)


def new_identities(incoming: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows whose identity (no part null) is not stored, each identity once."""
    return incoming.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


def load_facts(stored: DataFrame, incoming: DataFrame, cursor: DataFrame) -> DataFrame:
    """The stored facts after an incremental load: new filings only, last restatement wins, superseded facts go.

    A fact that comes in older than the one stored loses, one of the same filing replaces it: all by one window over both.
    """
    fresh = after_cursor(incoming, cursor).select(*stored.columns)
    both = stored.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
    return first_by(both, FACT_KEY, F.desc("filing_date"), F.desc("accession_no"), F.desc("__new")).drop("__new")


def advance_cursor(cursor: DataFrame, loaded: DataFrame) -> DataFrame:
    """Per company the greater of its cursor and the last filing loaded, by (date, accession)."""
    moved = loaded.groupBy("cik").agg(F.max(F.struct("filing_date", "accession_no")).alias("__new"))
    old = cursor.select(
        "cik",
        F.struct(F.col("last_filing_date").alias("filing_date"), F.coalesce("last_accession", F.lit("")).alias("accession_no")).alias("__old")
    )
    both = old.join(moved, "cik", "full_outer").select("cik", F.greatest("__old", "__new").alias("c"))
    return both.select(
        "cik", F.col("c.filing_date").alias("last_filing_date"), F.col("c.accession_no").alias("last_accession")
    )


def fiscal_context(filings: DataFrame, facts: DataFrame) -> DataFrame:
    """Filings with the most frequent (year, period) of their facts; ties go to the later year, then period."""
    counted = facts.groupBy("accession_no", "fiscal_year", "fiscal_period").agg(F.count("*").alias("__n"))
    top = first_by(counted, ["accession_no"], F.desc("__n"), F.desc("fiscal_year"), F.desc("fiscal_period")).drop("__n")
    return filings.join(top, "accession_no", "left")


def year_over_year(facts: DataFrame, from_year: int | None = None) -> DataFrame:
    """Change of each annual fact from the year before; gaps do not match and a zero base is left out.

    Facts are unique per ticker, metric, unit and year, as after :func:`latest_restatement`. A frame over the year before
    takes the place of a self-join: one scan, one shuffle.
    """
    before = Window.partitionBy("ticker", "metric", "unit").orderBy("fiscal_year").rangeBetween(-1, -1)
    annual = facts.where("fiscal_period = 'FY'").select(
        "ticker", "metric", "unit", "fiscal_year", F.col("value").cast("double").alias("to_value")
    )
    both = annual.withColumn("from_value", F.first("to_value").over(before)).where("from_value != 0")
    if from_year is not None:
        both = both.where(F.col("fiscal_year") > from_year)
    delta = F.col("to_value") - F.col("from_value")
    year = F.col("fiscal_year")
    return both.select(
        "ticker", "metric", "unit", (year - 1).alias("from_year"), year.alias("to_year"), "from_value", "to_value",
        delta.alias("delta"), (100 * delta / F.nullif("from_value", F.lit(0.0))).alias("percent_change")
    )


def latest_per_company(filings: DataFrame) -> DataFrame:
    return filings.groupBy("cik").agg(F.max(F.struct("filing_date", "accession_no")).alias("m")).select("cik", "m.*")


def validated(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass all rules, others with the first rule they fail). A rule that is null fails."""
    reason = reduce(
        lambda rest, x: F.when(~F.coalesce(x[1], F.lit(False)), F.lit(x[0])).otherwise(rest),
        reversed(list(rules.items())), F.lit(None).cast("string")
    )
    judged = df.withColumn("reject_reason", reason)
    return judged.where("reject_reason IS NULL").drop("reject_reason"), judged.where("reject_reason IS NOT NULL")


def same_metadata(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose rows disagree in some column."""
    return rows.groupBy(key).agg(F.count_distinct(F.struct(*columns)).alias("n")).where("n > 1").select(key)


def checked_metadata(rows: DataFrame, key: str, columns: list[str]) -> None:
    """Raises if rows of one key disagree in some column."""
    bad = same_metadata(rows, key, columns).limit(3).collect()
    if bad:
        raise ValueError(f"rows disagree in {', '.join(columns)}: {', '.join(str(r[0]) for r in bad)}")
