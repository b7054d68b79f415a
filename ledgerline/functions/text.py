"""Scalar text functions as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as V

# fixed values: words without weight in search
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of",
    "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)
TICKER = r"^[A-Z0-9]+(-[A-Z0-9]+)*$"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normal_ticker(x: str | Column) -> Column:
    """Trimmed capitals with dots as dashes; null if not a ticker."""
    out = F.translate(F.upper(F.trim(_c(x))), ".", "-")
    return F.when(out.rlike(TICKER), out)


def normal_ticker_value(x: str) -> str:
    out = x.strip().upper().replace(".", "-")
    if not re.fullmatch(TICKER, out):
        raise ValueError(f"{x!r} is not a ticker")
    return out


def normal_metric(x: str | Column) -> Column:
    """The canonical metric of a name in any spelling, or null."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(x))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.create_map(*[F.lit(v) for pair in V.METRIC_SYNONYMS.items() for v in pair])[key]


def words(x: str | Column) -> Column:
    """Lower-case words; an inner dash or apostrophe belongs to a word."""
    return F.regexp_extract_all(F.lower(_c(x)), F.lit(r"[a-z0-9]+(?:[-'][a-z0-9]+)?"), F.lit(0))


def terms(x: str | Column) -> Column:
    """Search terms: lower-case runs of letters and digits without stop words."""
    found = F.regexp_extract_all(F.lower(_c(x)), F.lit(r"[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS))


def fiscal_references(x: str | Column) -> Column:
    """Distinct (period, year) pairs such as "Q2 of FY2024" in order; a year alone has period FY."""
    pattern = r"(?i)\b(?:(Q[1-4])(?:\s+of)?\s+)?FY\s*([12]\d{3})\b"
    period = F.regexp_extract_all(_c(x), F.lit(pattern), F.lit(1))
    year = F.regexp_extract_all(_c(x), F.lit(pattern), F.lit(2))
    return F.array_distinct(
        F.zip_with(period, year, lambda p, y: F.struct(F.when(p == "", "FY").otherwise(F.upper(p)).alias("period"), y.cast("int").alias("year")))
    )


def normal_line(x: str | Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(_c(x), r"(?U)\s+", " "))


def heading_signature(x: str | Column) -> Column:
    """A heading for comparison: lower case, plain quotes and dashes, no closing "(continued)" or punctuation."""
    return reduce(lambda text, step: F.regexp_replace(text, *step), V.HEADING_STEPS, F.lower(normal_line(x)))


def heading_key(text: str) -> str:
    """The same for one text."""
    return reduce(lambda t, step: re.sub(step[0], step[1], t), V.HEADING_STEPS, " ".join(text.split()).casefold())


def boilerplate_signature(x: str | Column) -> Column:
    """Page footers with their number masked; null for lines that are no footer."""
    low = F.lower(_c(x))
    label = reduce(Column.__or__, map(low.contains, V.FORM_LABELS))
    footer = low.rlike(V.FOOTER_NUMBER) | (label & low.contains("|"))
    return F.when(footer & (F.length(low) <= V.FOOTER_LENGTH), F.regexp_replace(low, V.FOOTER_NUMBER, "$1#"))


def footer_key(text: str) -> str | None:
    """The same for one text."""
    low = text.casefold()
    masked, found = re.subn(V.FOOTER_NUMBER, r"\1#", low)
    is_footer = found or ("|" in low and any(label in low for label in V.FORM_LABELS))
    return masked if is_footer and len(low) <= V.FOOTER_LENGTH else None


def size_bucket(tokens: str | Column) -> Column:
    return F.when(_c(tokens) < 400, "small").when(_c(tokens) < 680, "medium").otherwise("large")


def numeric_cell(x: str | Column) -> Column:
    return F.regexp_replace(_c(x), r"[\s$€£¥%(),.\-–—]", "").rlike(r"^\d+$")


def page_number(x: str | Column) -> Column:
    """A line that is a page's number, with a letter or the word before it or not."""
    return _c(x).rlike(r"(?i)^(?:page\s+)?(?:[A-Z]-)?\d{1,4}$")


def reference_stub(x: str | Column) -> Column:
    """A short section that only points elsewhere."""
    return (F.length(_c(x)) < V.STUB_LENGTH) & _c(x).rlike("(?is)" + "|".join(V.STUB_PHRASES))


def spaced(word_array: Column) -> Column:
    """Words between single spaces, one before the first and after the last: a run of words is a part of it."""
    return F.concat(F.lit(" "), F.array_join(word_array, " "), F.lit(" "))


def copied_run(question: Column, source: Column, n: int = 5) -> Column:
    """Whether n words in a row of an array stand in a text of words made by :func:`spaced`, best a column of its own."""
    starts = F.when(
        F.size(question) >= n, F.sequence(F.lit(1), F.size(question) - n + 1)
    ).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda i: F.contains(source, spaced(F.slice(question, i, n))))


def elapsed_ms(nanoseconds: str | Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(_c(nanoseconds) / 1e6)).cast("long")


def money(x: str | Column, unit: str = "$") -> Column:
    """A large number with a scale letter, three digits of precision at most."""
    v, size = _c(x), F.abs(_c(x))
    scaled = [(1e12, "T"), (1e9, "Md"), (1e6, "M"), (1e3, "k")]
    out = F.format_number(v, 2)
    for limit, letter in reversed(scaled):
        out = F.when(size >= limit, F.concat(F.format_number(v / limit, 2), F.lit(f" {letter}"))).otherwise(out)
    return F.concat(F.translate(out, ",.", " ,"), F.lit(f" {unit}"))
