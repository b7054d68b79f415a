"""Landed files of the filings service: tickers, submissions, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions.text import normal_ticker
from ..operators.facts import first_by

PARALLEL = "accessionNumber array<string>, form array<string>, filingDate array<string>, reportDate array<string>, primaryDocument array<string>"
SUBMISSIONS = f"filings struct<recent:struct<{PARALLEL.replace(' array', ':array')}>, files:array<struct<name:string,filingTo:string>>>"
NAMES = ("accessionNumber", "form", "filingDate", "reportDate", "primaryDocument")


def landing_key(url: str | Column) -> Column:
    """The name under which a response is landed."""
    return F.sha2(F.col(url) if isinstance(url, str) else url, 256)


def allowed_url(url: str | Column, hosts: tuple[str, ...] = ("www.sec.gov", "data.sec.gov")) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(
        (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.try_parse_url(url, F.lit("HOST")).isin(*hosts),
        F.lit(False)
    )


def padded_cik(cik: str | Column) -> Column:
    return F.lpad((F.col(cik) if isinstance(cik, str) else cik).cast("string"), 10, "0")


def company_index(tickers: DataFrame) -> DataFrame:
    """(ticker, cik, name) of (json) ticker files, keyed by normal ticker; two companies under one ticker are an error."""
    rows = tickers.select(
        F.posexplode(F.map_values(F.from_json("json", "map<string, struct<cik_str:bigint,ticker:string,title:string>>"))).alias("at", "r")
    )
    known = rows.select(
        "at", normal_ticker("r.ticker").alias("ticker"), F.col("r.cik_str").alias("cik"), F.col("r.title").alias("name")
    )
    bad = known.where("ticker IS NULL OR cik IS NULL OR name IS NULL")
    if not bad.isEmpty():
        raise ValueError("a ticker record is not complete")
    if not known.groupBy("ticker").agg(F.count_distinct("cik").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a ticker stands for two companies")
    return first_by(known, ["ticker"], F.desc("at")).drop("at")


def resolve_tickers(spark: SparkSession, wanted: list[str], index: DataFrame) -> DataFrame:
    """The wanted companies in order, each once; an unknown ticker is an error."""
    rows = spark.createDataFrame(
        [(i, t) for i, t in enumerate(wanted)], "at int, raw string"
    ).select("at", normal_ticker("raw").alias("ticker"))
    found = first_by(rows, ["ticker"], F.asc("at")).join(index, "ticker", "left")
    unknown = [r["ticker"] for r in found.where("cik IS NULL").collect()]
    if unknown:
        raise ValueError(f"unknown tickers: {unknown}")
    return found.orderBy("at").drop("at")


def submission_filings(payloads: DataFrame) -> DataFrame:
    """Filings of (cik, json): parallel arrays of equal length as rows, annual and quarterly forms only, amendments under their form, none without a document.

    A payload is a company's submissions, or one of its history files, which holds the arrays at its root. ``part`` and
    ``place`` tell where a filing stood: a column ``part`` of the payloads (0 if there is none), and its place in the arrays.
    """
    part = F.col("part") if "part" in payloads.columns else F.lit(0)
    root = F.from_json("json", f"struct<{PARALLEL.replace(' array', ':array')}>")
    recent = F.from_json("json", SUBMISSIONS)["filings"]["recent"]
    doc = payloads.select(
        "cik", part.cast("int").alias("part"), F.coalesce(recent, root).alias("d")
    ).select("cik", "part", "d.*")
    sizes = [F.size(n) for n in NAMES]
    equal = sizes[0] == sizes[1]
    for s in sizes[2:]:
        equal &= sizes[0] == s
    checked = doc.withColumn(
        "accessionNumber",
        F.when(equal, F.col("accessionNumber")).otherwise(F.raise_error(F.lit("submission arrays differ in length")).cast("array<string>"))
    )
    rows = checked.select(
        "cik", "part", F.posexplode(F.arrays_zip(*NAMES)).alias("place", "f")
    ).select("cik", "part", "place", "f.*")
    form = F.create_map(*[F.lit(x) for pair in V.FORMS.items() for x in pair])[F.col("form")]
    empty = F.lit("")
    return rows.where(F.col("form").isin(*V.FORMS) & (F.coalesce("primaryDocument", empty) != "")).select(
        "cik", F.col("accessionNumber").alias("accession_no"), form.alias("form_type"), F.try_to_date("filingDate").alias("filing_date"),
        F.try_to_date(F.nullif("reportDate", empty)).alias("period_of_report"), F.col("primaryDocument").alias("primary_document"),
        document_url("cik", "accessionNumber", "primaryDocument").alias("primary_doc_url"), "part", "place",
    )


def document_url(cik: str, accession: str, document: str) -> Column:
    return F.concat(
        F.lit("https://www.sec.gov/Archives/edgar/data/"), F.col(cik).cast("string"), F.lit("/"),
        F.regexp_replace(accession, "-", ""), F.lit("/"), F.col(document)
    )


def history_files(payloads: DataFrame, cursor: DataFrame) -> DataFrame:
    """History files (cik, part, name), parts counted from 1 in their order, that may hold filings from the cursor's day on; an unknown end is kept."""
    listed = F.posexplode(F.from_json("json", SUBMISSIONS).getField("filings").getField("files")).alias("at", "f")
    files = payloads.select("cik", listed).select("cik", (F.col("at") + 1).alias("part"), "f.*")
    return files.join(cursor.select("cik", "last_filing_date"), "cik", "left").where(
        F.col("last_filing_date").isNull() | F.col("filingTo").isNull() | (F.try_to_date("filingTo") >= F.col("last_filing_date"))
    ).select("cik", "part", "name")


def new_filings(filings: DataFrame, cursor: DataFrame) -> DataFrame:
    """Filings after the cursor by (date, accession), each accession once (the last met by part and place), oldest first."""
    order = [F.desc(x) for x in ("part", "place") if x in filings.columns] or [F.desc("primary_doc_url")]
    return after_cursor(first_by(filings, ["accession_no"], *order), cursor).orderBy("filing_date", "accession_no")


def after_cursor(filings: DataFrame, cursor: DataFrame) -> DataFrame:
    """All listed filings after their company's cursor by (date, accession); one that is listed twice stands twice."""
    c = cursor.select(
        "cik", F.col("last_filing_date").alias("__d"), F.coalesce("last_accession", F.lit("")).alias("__a")
    )
    after = F.col("__d").isNull() | (
        F.struct("filing_date", "accession_no") > F.struct(F.col("__d").alias("filing_date"), F.col("__a").alias("accession_no"))
    )
    return filings.join(c, "cik", "left").where(after).drop("__d", "__a")


def discovery_status(forms: DataFrame) -> DataFrame:
    """OK, or SKIPPED with a reason for companies (cik, forms array) without an annual report."""
    annual = F.exists("forms", lambda x: x.isin("10-K", "10-K/A"))
    return forms.select(
        "cik", F.when(annual, "OK").otherwise("SKIPPED").alias("status"),
        F.when(~annual, "no annual report").alias("reason")
    )


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of landed documents; bytes that are not UTF-8 become replacement characters."""
    return spark.read.format("binaryFile").load(path).select(
        "path", F.make_valid_utf8(F.col("content").cast("string")).alias("html")
    )
