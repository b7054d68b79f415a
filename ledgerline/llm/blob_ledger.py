"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its bytes. The ledger
remembers which (blob, rule version) pairs were scanned and what was found, so a
run scans one representative row of each unseen pair and joins the findings back
to every path that holds the blob.

Defined results: a null text is the empty blob; repeated rows and ids each give
a row, null ids too; a blob without findings is remembered too, with an empty list;
texts are scanned whole at any length; an empty table gives no rows. Columns beside
keys and text are not read, whatever their names; keys named ``blob`` or ``findings``
are refused, as the result has columns of these names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``least`` characters of group ``group`` or the match fails. A change needs a new version."""

    kind: str
    version: str
    pattern: str
    group: int
    least: int


RULES = (
    Rule("assign", "1", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # a run shorter than the least has no later start that is long enough, so the least can stand in the pattern
    Rule("access", "1", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", "1", r"[0-9a-f]{24,}", 0, 24),
)

FINDINGS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"
LEDGER = f"blob binary, rules string, findings {FINDINGS}"


def rule_version(rules: Iterable[Rule]) -> str:
    return ",".join(f"{r.kind}@{r.version}" for r in rules)


def scan(text: str | None, rules: Iterable[Rule], compiled: list[re.Pattern]) -> list[dict]:
    """Spans (code points, end exclusive) of all rules by start, then by the rules' order."""
    found = []
    for rank, (rule, pattern) in enumerate(zip(rules, compiled)):
        for m in pattern.finditer(text or ""):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), rank, rule.kind, m.end()))
    return [dict(zip(("start", "rank", "kind", "end"), x)) for x in sorted(found)]


def addressed(versions: DataFrame, text_col: str) -> DataFrame:
    """The rows with the content address of their text."""
    return versions.withColumn("__blob", F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))


def scan_unseen(
    versions: DataFrame, ledger: DataFrame | None, *, key_cols: list[str], text_col: str = "text",
    rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Rows of the ledger for all blobs of ``versions`` that it lacks under these rules.

    ``key_cols`` name a path's version; the smallest of them represents its blob.
    """
    version = rule_version(rules)
    keyed = addressed(
        versions.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(key_cols)], F.col(text_col).alias("__text")),
        "__text"
    )
    keys = [f"__k{i}" for i in range(len(key_cols))]
    # one path of each blob; only addresses are grouped, texts are not
    first = keyed.groupBy("__blob").agg(F.min(F.struct(*keys)).alias("__first"))
    if ledger is not None:
        first = first.join(
            ledger.where(F.col("rules") == version).select(F.col("blob").alias("__blob")).distinct(), "__blob",
            "left_anti"
        )
    first = first.select(F.col("__blob").alias("__want"), *[F.col(f"__first.{k}").alias(f"__w{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__w{k}")) for k in keys]
    on = same[0]
    for x in same[1:]:
        on &= x
    chosen = keyed.join(first.hint("shuffle_hash"), on & (F.col("__blob") == F.col("__want")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
        kind = pa.list_(
            pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int64())])
        )
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([version] * part.num_rows, pa.string()), pa.array([scan(t, rules, compiled) for t in part.column(1).to_pylist()], kind)],
                    ["blob", "rules", "findings"]
                )

    out = T._parse_datatype_string(LEDGER)
    # the same row may stand twice in the input
    return chosen.select("__blob", "__text").mapInArrow(run, out).dropDuplicates(["blob"])


def findings(
    versions: DataFrame, ledger: DataFrame, *, key_cols: list[str], text_col: str = "text",
    rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Every row of ``versions`` (its key columns) with the ledger's findings for its blob under these rules."""
    if taken := {"blob", "findings"}.intersection(key_cols):
        raise ValueError(f"keys are named like the ledger's own columns: {', '.join(sorted(taken))}")
    held = ledger.where(F.col("rules") == rule_version(rules)).select(F.col("blob").alias("__blob"), "findings")
    return addressed(
        versions.select(*key_cols, F.col(text_col).alias("__text")), "__text"
    ).select(*key_cols, F.col("__blob").alias("blob")).join(held.withColumnRenamed("__blob", "blob"), "blob", "left").select(*key_cols, "blob", "findings")


def scan_all(
    versions: DataFrame, ledger: DataFrame | None = None, *, key_cols: list[str], text_col: str = "text",
    rules: tuple[Rule, ...] = RULES
) -> tuple[DataFrame, DataFrame]:
    """(findings of every row, the ledger with what was scanned now)."""
    new = written(scan_unseen(versions, ledger, key_cols=key_cols, text_col=text_col, rules=rules), "ledger")
    whole = new if ledger is None else ledger.unionByName(new)
    return findings(versions, whole, key_cols=key_cols, text_col=text_col, rules=rules), whole
