"""Line and section operators on filings, as DataFrame plans over (doc, n, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions.text import boilerplate_signature, normal_line


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Normalised lines in order, without empty ones."""
    rows = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("n", "line"))
    return rows.withColumn("line", normal_line("line")).where("line != ''")


def without_repeats(lines: DataFrame) -> DataFrame:
    """Lines that differ from the one before."""
    before = F.lag("line").over(Window.partitionBy("doc").orderBy("n"))
    return lines.withColumn("__before", before).where(~F.col("line").eqNullSafe(F.col("__before"))).drop("__before")


def without_boilerplate(lines: DataFrame, least: int = 3, signature: Column | None = None) -> DataFrame:
    """Lines without footers that stand at least ``least`` times in their document."""
    signed = lines.withColumn("__s", boilerplate_signature("line") if signature is None else signature)
    repeated = signed.where("__s IS NOT NULL").groupBy("doc", "__s").agg(
        F.count("*").alias("__n")
    ).where(F.col("__n") >= least).drop("__n")
    return signed.join(repeated, ["doc", "__s"], "left_anti").drop("__s")


PART = r"(?i)^part\s+(i{1,3}|iv)\b\W*$"
ITEM = r"(?i)^(?:part\s+(i{1,3}|iv)\s*[,.\-–—]?\s*)?item\s+(\d{1,2}[abc]?)\s*[.:\-–—]?\s*(.*)$"


def section_of(form: Column, part: Column, item: Column) -> Column:
    annual = F.create_map(*[F.lit(x) for p in V.ANNUAL_ITEMS.items() for x in p])[item]
    exact = F.create_map(
        *[F.lit(x) for (p, i), s in V.QUARTERLY_ITEMS.items() for x in (f"{p}|{i}", s)]
    )[F.concat_ws("|", F.coalesce(part, F.lit("")), item)]
    loose = F.create_map(*[F.lit(x) for p in V.QUARTERLY_FALLBACK.items() for x in p])[item]
    return F.when(form == "10-K", annual).when(form == "10-Q", F.coalesce(exact, loose))


def sections(lines: DataFrame, forms: DataFrame) -> DataFrame:
    """The largest candidate of each section: rows (doc, section, text).

    Headings carry their part forward and open a segment; lines belong to the segment they follow. Window functions
    over each document, no state in Python. A document without sections is returned whole.
    """
    w = Window.partitionBy("doc").orderBy("n")
    is_part = F.col("line").rlike(PART)
    is_item = F.col("line").rlike(ITEM) & ~is_part
    own_part = F.upper(
        F.when(is_part, F.regexp_extract("line", PART, 1)).when(is_item, F.nullif(F.regexp_extract("line", ITEM, 1), F.lit("")))
    )
    marked = lines.join(forms, "doc").withColumn("__head", is_part | is_item).withColumn(
        "__item", F.when(is_item, F.upper(F.regexp_extract("line", ITEM, 2)))
    ).withColumn("__title", F.when(is_item, F.trim(F.regexp_extract("line", ITEM, 3))))
    marked = marked.withColumn(
        "__part", F.last(own_part, ignorenulls=True).over(w)
    ).withColumn("__seg", F.sum(F.col("__head").cast("int")).over(w))
    seg = Window.partitionBy("doc", "__seg").orderBy("n")
    named = marked.withColumn(
        "section",
        F.first(F.when(F.col("__head"), F.struct(section_of(F.col("form_type"), F.col("__part"), F.col("__item")).alias("s")))).over(seg)["s"]
    )
    text = F.when(F.col("__head"), F.nullif("__title", F.lit(""))).otherwise(F.col("line"))
    pieces = named.where("section IS NOT NULL").groupBy("doc", "section", "__seg").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))), lambda x: x["t"]), "\n").alias("text")
    ).where("text != ''")
    best = pieces.groupBy("doc", "section").agg(
        F.max(F.struct(F.length("text").alias("l"), F.col("text"))).alias("m")
    ).select("doc", "section", F.col("m.text").alias("text"))
    whole = lines.join(best.select("doc").distinct(), "doc", "left_anti").groupBy("doc").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text")
    )
    return best.unionByName(whole.select("doc", F.lit(V.WHOLE_FILING).alias("section"), "text"))
