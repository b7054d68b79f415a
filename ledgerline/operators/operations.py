"""Dashboards, costs and token usage over the query log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed(log: DataFrame, unit: str) -> DataFrame:
    return log.withColumn("time", F.date_trunc(unit, "created_at"))


def volume(log: DataFrame, unit: str = "day") -> DataFrame:
    return bucketed(log, unit).groupBy("time").agg(F.count("*").cast("double").alias("requests"))


def latency(log: DataFrame, unit: str = "day") -> DataFrame:
    """Mean and interpolated 95th percentile of known latencies."""
    return bucketed(log.where("latency_ms IS NOT NULL"), unit).groupBy("time").agg(
        F.avg("latency_ms").cast("double").alias("average"), F.percentile("latency_ms", 0.95).alias("p95")
    )


def cumulative_cost(log: DataFrame, unit: str = "day") -> DataFrame:
    """Running cost. Rows are summed to buckets first, so the one-task window sees buckets, not rows."""
    buckets = bucketed(log, unit).groupBy("time").agg(
        F.sum(F.coalesce("cost_usd", F.lit(0))).cast("double").alias("cost")
    )
    return buckets.select("time", F.sum("cost").over(Window.orderBy("time")).alias("cumulative_cost"))


def intents(log: DataFrame) -> DataFrame:
    return log.groupBy(
        F.coalesce(F.nullif("intent", F.lit("")), F.lit("unknown")).alias("intent")
    ).agg(F.count("*").cast("double").alias("n"))


def percent(condition: Column) -> Column:
    """Share of rows in percent, 0 of none; a null condition does not hold."""
    return F.coalesce((100.0 * F.count_if(condition) / F.nullif(F.count("*"), F.lit(0))).cast("double"), F.lit(0.0))


def grounded_rate(log: DataFrame) -> DataFrame:
    return log.agg(percent(F.col("grounded")).alias("grounded_rate"))


def positive_rate(feedback: DataFrame) -> DataFrame:
    return feedback.agg(percent(F.col("rating") == 1).alias("positive_rate"))


def call_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds ``cost`` to calls (model, kind, input_tokens, cached_tokens, output_tokens) by a price table (model, kind, input, cached, output per million); unknown models cost nothing.

    A model that stands twice in the table takes its first row by ``rank``.
    """
    money = "decimal(38,12)"
    first = prices.withColumn(
        "__r", F.row_number().over(Window.partitionBy("model", "kind").orderBy("rank"))
    ).where("__r = 1").drop("__r", "rank")
    # prices per token first: decimals keep all twelve digits that way
    price = lambda c: F.coalesce(F.col(c).cast("decimal(12,6)"), F.lit(0).cast("decimal(12,6)")) * F.lit("0.000001").cast("decimal(7,6)")
    tokens = lambda c: c.cast("decimal(12,0)")
    total, cached, output = F.col("input_tokens"), F.col("cached_tokens"), F.col("output_tokens")
    model = tokens(
        F.greatest(total - cached, F.lit(0))
    ) * price("input") + tokens(cached) * price("cached") + tokens(output) * price("output")
    cost = F.when(F.col("kind") == "embedding", tokens(total) * price("input")).otherwise(model)
    return calls.withColumn("model", F.trim("model")).join(
        F.broadcast(first), ["model", "kind"], "left"
    ).withColumn("cost", cost.cast(money)).drop("input", "cached", "output")


def usage(raw: str | Column) -> Column:
    """(input, cached, output) of a usage report in either field naming; bad or negative counts are 0, cached at most input."""
    raw = F.col(raw) if isinstance(raw, str) else raw

    def count(*paths: str) -> Column:
        return F.greatest(
            F.coalesce(*[F.get_json_object(raw, p).try_cast("bigint") for p in paths], F.lit(0)), F.lit(0)
        )

    total = count("$.input_tokens", "$.prompt_tokens")
    cached = F.least(count("$.input_tokens_details.cached_tokens", "$.prompt_tokens_details.cached_tokens"), total)
    return F.struct(
        total.alias("input_tokens"), cached.alias("cached_tokens"),
        count("$.output_tokens", "$.completion_tokens").alias("output_tokens")
    )


def trace_totals(calls: DataFrame) -> DataFrame:
    """Tokens and cost of each stage of each request."""
    return calls.groupBy("trace_id", "stage").agg(
        *[F.sum(c).alias(c) for c in ("input_tokens", "cached_tokens", "output_tokens", "cost")]
    )


def ingestion_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("status").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"))
