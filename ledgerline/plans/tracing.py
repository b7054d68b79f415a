"""Requests and loads as nested spans, with rows counted by the jobs that make them.

A span is open while its ``with`` block runs; spans opened inside of it are its
children, also across functions, as a context variable holds the open one. A stage
that runs a Spark job counts what passes through it by an observation on that very
job: no second job counts, and a stage that never ran has no counts. Without an
open trace all of this does nothing, so operators may always be called alone.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import elapsed_ms
from ..operators import operations
from ..sources import tables

SPANS = (
    "trace_id string, span_id int, parent_id int, stage string, latency_ns long, error string, counts map<string,long>"
)
CALLS = "trace_id string, span_id int, stage string, model string, kind string, input_tokens long, cached_tokens long, output_tokens long"
PRICES = "rank int, model string, kind string, input string, cached string, output string"


@dataclass
class Span:
    number: int
    parent: int | None
    name: str
    nanoseconds: int = 0
    error: str | None = None
    counts: dict[str, int] = field(default_factory=dict)


@dataclass
class Trace:
    """One request or load: its spans in the order they were opened, and the calls of models in them."""

    trace_id: str
    question: str | None = None
    session_id: str | None = None
    spans: list[Span] = field(default_factory=list)
    calls: list[tuple] = field(default_factory=list)

    def span_rows(self, spark: SparkSession) -> DataFrame:
        rows = [(self.trace_id, s.number, s.parent, s.name, s.nanoseconds, s.error, s.counts) for s in self.spans]
        return spark.createDataFrame(rows, SPANS).withColumn("latency_ms", elapsed_ms("latency_ns")).drop("latency_ns")

    def call_rows(self, spark: SparkSession, prices: DataFrame | None = None) -> DataFrame:
        """Calls with their ``cost``; without prices they cost nothing."""
        known = prices if prices is not None else spark.createDataFrame([], PRICES)
        return operations.call_cost(spark.createDataFrame(self.calls, CALLS), known)

    def stage_totals(self, spark: SparkSession, prices: DataFrame | None = None) -> DataFrame:
        """Rows (trace_id, stage, latency_ms, spans, tokens, cost): all spans of a name, with or without calls."""
        spans = self.span_rows(spark).groupBy("trace_id", "stage").agg(
            F.sum("latency_ms").alias("latency_ms"), F.count("*").alias("spans"), F.count("error").alias("errors")
        )
        return spans.join(operations.trace_totals(self.call_rows(spark, prices)), ["trace_id", "stage"], "left")

    def log_row(
        self, spark: SparkSession, *, intent: str, route: str, grounded: bool, prices: DataFrame | None = None
    ) -> DataFrame:
        """The request's row of ``query_logs``; its latency is that of the outermost spans."""
        spent = sum(s.nanoseconds for s in self.spans if s.parent is None)
        row = spark.createDataFrame(
            [(self.trace_id, self.session_id, self.question, intent, route, spent, grounded)],
            "trace_id string, session_id string, question string, intent string, route string, ns long, grounded boolean",
        )
        columns = ("input_tokens", "output_tokens", "cached_tokens", "cost")
        used = operations.trace_totals(self.call_rows(spark, prices)).groupBy("trace_id").agg(*[F.sum(c).alias(c) for c in columns])
        out = row.join(used, "trace_id", "left").withColumn("latency_ms", elapsed_ms("ns").cast("int"))
        money = F.coalesce("cost", F.lit(0)).cast("decimal(38,12)").alias("cost_usd")
        tokens = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in columns[:3]]
        wanted = ("trace_id", "session_id", "question", "intent", "route", "latency_ms")
        return out.select(*wanted, *tokens, money, "grounded", F.current_timestamp().alias("created_at"))


_TRACE: ContextVar[Trace | None] = ContextVar("ledgerline_trace", default=None)
_SPAN: ContextVar[Span | None] = ContextVar("ledgerline_span", default=None)


@contextmanager
def trace(question: str | None = None, *, trace_id: str | None = None, session_id: str | None = None) -> Iterator[Trace]:
    """Spans and calls in the block belong to a new trace."""
    state = Trace(trace_id or uuid.uuid4().hex, question, session_id)
    before, inner = _TRACE.set(state), _SPAN.set(None)
    try:
        yield state
    finally:
        _SPAN.reset(inner)
        _TRACE.reset(before)


@contextmanager
def span(name: str) -> Iterator[Span | None]:
    """A timed stage of the open trace; its error is noted and goes on."""
    state = _TRACE.get()
    if state is None:
        yield None
        return
    parent = _SPAN.get()
    now = Span(len(state.spans), parent.number if parent else None, name)
    state.spans.append(now)
    before, began = _SPAN.set(now), time.perf_counter_ns()
    try:
        yield now
    except Exception as e:
        now.error = f"{type(e).__name__}: {e}"[:500]
        raise
    finally:
        now.nanoseconds = time.perf_counter_ns() - began
        _SPAN.reset(before)


def called(model: str, kind: str, usage: dict[str, int]) -> None:
    """Notes a model's tokens in the open span; cached ones count as input too."""
    state, now = _TRACE.get(), _SPAN.get()
    if state is not None:
        spent = [max(0, int(usage.get(k) or 0)) for k in ("input_tokens", "cached_tokens", "output_tokens")]
        spent[1] = min(spent[0], spent[1])
        state.calls.append((state.trace_id, now.number if now else None, now.name if now else "request", model, kind, *spent))


def ran[T](df: DataFrame, action: Callable[[DataFrame], T], prefix: str = "", **also: Column) -> T:
    """What ``action`` makes of ``df``, with the rows that pass and sums ``also`` noted in the open span.

    The action must run the whole of ``df`` once, as a write or a collect does.
    """
    now = _SPAN.get()
    if now is None:
        return action(df)
    seen = Observation(f"span-{uuid.uuid4().hex}")
    out = action(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in also.items()]))
    for name, value in seen.get.items():
        now.counts[prefix + name] = int(value or 0)
    return out


def logged(rows: DataFrame, path: str) -> None:
    """Append rows of ``query_logs``."""
    tables.append(rows, path)
