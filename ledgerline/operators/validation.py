"""Rules for rows before they are stored; use with :func:`ledgerline.operators.facts.validated`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as V


def _text(name: str) -> Column:
    return F.length(F.trim(name)) > 0


def _period(required: bool) -> Column:
    known = F.col("fiscal_period").isin(*V.PERIODS)
    return known if required else F.col("fiscal_period").isNull() | known


def fact_rules() -> dict[str, Column]:
    return {
        "cik": F.col("cik") > 0, "ticker": _text("ticker"), "metric": F.col("metric").isin(*V.METRIC_TAGS), "taxonomy_tag": _text("taxonomy_tag"), "unit": F.col("unit").isin(*V.UNITS), "fiscal_year": F.col("fiscal_year") > 0,
        "fiscal_period": _period(True), "period_end": F.col("period_end").isNotNull(), "period_order": F.col("period_start").isNull() | (F.col("period_start") <= F.col("period_end")), "value": F.col("value").isNotNull(),
        "form_type": F.col("form_type").isin("10-K", "10-Q"), "filing_date": F.col("filing_date").isNotNull(), "accession_no": F.col("accession_no").rlike(V.ACCESSION), "source_url": F.col("source_url").startswith("https://"),
    }


def section_rules() -> dict[str, Column]:
    return {
        "accession_no": _text("accession_no"), "cik": F.col("cik") > 0, "ticker": _text("ticker"), "section": F.col("section").isin("MD&A", "Risk Factors", "Notes", V.WHOLE_FILING), "text": _text("text"),
        "fiscal_year": F.col("fiscal_year").isNull() | (F.col("fiscal_year") > 0), "fiscal_period": _period(False), "source_url": F.col("source_url").startswith("https://"),
    }


def chunk_rules(dimensions: int) -> dict[str, Column]:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return section_rules() | {
        "chunk_index": F.col("chunk_index") >= 0, "token_count": F.col("token_count") > 0,
        "embedding": (F.size("embedding") == dimensions) & finite
    }


def feedback_rules() -> dict[str, Column]:
    return {"trace_id": _text("trace_id"), "rating": F.col("rating").isin(-1, 1)}
