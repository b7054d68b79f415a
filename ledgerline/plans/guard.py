"""Guarded SQL: text is parsed, its plan walked against allow-lists, then analysed over restricted views and capped.

Nothing reaches ``spark.sql`` before the walk, because commands run when they are analysed.
"""

from __future__ import annotations

import re
import threading
import uuid

from py4j.java_gateway import JavaObject
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import READ_ONLY, read_only_session

MAX_ROWS = 100
RESULT = frozenset(("metric", "fiscal_year", "fiscal_period", "value", "unit"))
# fixed values: tables and columns that user SQL may read
TABLES = {
    "financial_facts": "id cik ticker metric taxonomy_tag unit fiscal_year fiscal_period period_start period_end value form_type filing_date accession_no source_url".split(),
    "companies": "cik ticker name sic updated_at".split(),
    "filings": "accession_no cik form_type filing_date period_of_report primary_doc_url".split(),
}
# fixed values: functions that user SQL may call
FUNCTIONS = frozenset(
    "abs avg cast ceil coalesce count date_trunc extract floor greatest if lag lead least lower max min nullif power round row_number sum upper".split()
)
# operators that the parser turns into functions
OPERATORS = frozenset(("between",))
NODES = frozenset(
    "Project Filter Aggregate Join Union Intersect Except Sort GlobalLimit LocalLimit Offset SubqueryAlias UnresolvedRelation UnresolvedHaving UnresolvedWith Distinct UnresolvedSubqueryColumnAliases".split()
)
ROOTS = frozenset("Project Aggregate Distinct UnresolvedHaving UnresolvedWith".split())
# wrappers and operators that are part of the language, not functions
SYNTAX = frozenset(
    """Alias UnresolvedAlias UnresolvedAttribute Literal Cast CaseWhen And Or Not In InSubquery EqualTo EqualNullSafe LessThan LessThanOrEqual
    GreaterThan GreaterThanOrEqual IsNull IsNotNull Add Subtract Multiply Divide Remainder UnaryMinus UnaryPositive Like Between ScalarSubquery
    Exists ListQuery WindowExpression WindowSpecDefinition SpecifiedWindowFrame UnspecifiedFrame$ UnboundedPreceding$ UnboundedFollowing$ CurrentRow$
    SortOrder UnresolvedFunction UnresolvedOrdinal Extract Concat TryCast UnresolvedWindowExpression""".split()
)


# the schema's name, in quotes of identifiers or not, goes from the text; texts and other identifiers in quotes, and comments, are kept
_UNQUALIFIED = re.compile(
    r"(?P<kept>'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|--[^\n]*|/\*.*?\*/)|(?:\bpublic\b|`public`)\s*\.\s*", re.IGNORECASE | re.DOTALL
)


class SqlRejected(ValueError):
    """The text is not an allowed query."""


def _seq(x: JavaObject) -> list[JavaObject]:
    return [x.apply(i) for i in range(x.size())]


def _kind(x: JavaObject) -> str:
    return x.getClass().getSimpleName()


def _expressions(node: JavaObject) -> list[JavaObject]:
    return _seq(node.expressions().toIndexedSeq())


def _parts(x: JavaObject) -> list[str]:
    return [str(p) for p in _seq(x.toIndexedSeq())]


class _Walk:
    def __init__(self) -> None:
        self.tables: set[str] = set()
        self.ctes: list[set[str]] = [set()]

    def plan(self, node: JavaObject) -> None:
        kind = str(node.nodeName())
        if kind not in NODES:
            raise SqlRejected(f"{kind} is not allowed")
        if kind == "UnresolvedRelation":
            self.relation(_parts(node.multipartIdentifier()))
            return
        if kind == "UnresolvedWith":
            self.ctes.append(set(self.ctes[-1]))
            for pair in _seq(node.cteRelations().toIndexedSeq()):
                self.plan(pair._2())
                self.ctes[-1].add(str(pair._1()).lower())
            self.plan(node.child())
            self.ctes.pop()
            return
        if kind == "Join" and "Using" in str(node.joinType().getClass().getSimpleName()):
            raise SqlRejected("JOIN USING is not allowed")
        if kind == "Join" and "Natural" in str(node.joinType().getClass().getSimpleName()):
            raise SqlRejected("NATURAL JOIN is not allowed")
        for e in _expressions(node):
            self.expression(e)
        for child in _seq(node.children().toIndexedSeq()):
            self.plan(child)

    known: frozenset[str] = frozenset(TABLES)

    def relation(self, parts: list[str]) -> None:
        names = [p.lower() for p in parts]
        if len(names) == 2 and names[0] == "public":
            names = names[1:]
        if len(names) != 1:
            raise SqlRejected(f"{'.'.join(parts)} is not a table")
        if names[0] in self.ctes[-1]:
            return
        if names[0] not in self.known:
            raise SqlRejected(f"table {names[0]} is not allowed")
        self.tables.add(names[0])

    def expression(self, e: JavaObject) -> None:
        kind = _kind(e)
        if kind in ("UnresolvedStar", "UnresolvedRegex"):
            raise SqlRejected("* is not allowed")
        if kind == "UnresolvedFunction":
            name = _parts(e.nameParts())
            if len(name) != 1 or name[0].lower() not in FUNCTIONS | OPERATORS:
                raise SqlRejected(f"function {'.'.join(name)} is not allowed")
        elif kind not in SYNTAX:
            raise SqlRejected(f"{kind} is not allowed")
        if kind in ("ScalarSubquery", "Exists", "ListQuery"):
            self.plan(e.plan())
        elif kind == "InSubquery":
            self.plan(e.query().plan())
            for v in _seq(e.values().toIndexedSeq()):
                self.expression(v)
            return
        for child in _seq(e.children().toIndexedSeq()):
            self.expression(child)


class _Reads(_Walk):
    """Any query, if it reads known tables only."""

    def __init__(self, known: frozenset[str]):
        super().__init__()
        self.known = known

    def plan(self, node: JavaObject) -> None:
        kind = str(node.nodeName())
        if kind in ("UnresolvedRelation", "UnresolvedWith"):
            super().plan(node)
            return
        children = _seq(node.children().toIndexedSeq())
        if kind in WRITES or "Command" in kind or not (children or kind == "OneRowRelation"):
            raise SqlRejected(f"{kind} is not allowed")
        for e in _expressions(node):
            self.expression(e)
        for child in children:
            self.plan(child)

    def expression(self, e: JavaObject) -> None:
        if _kind(e) in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            self.plan(e.plan())
        if _kind(e) == "InSubquery":
            self.plan(e.query().plan())
        if _kind(e) == "UnresolvedFunction" and _parts(e.nameParts())[-1].lower() in REACHING:
            raise SqlRejected("functions that reach out of the query are not allowed")
        for child in _seq(e.children().toIndexedSeq()):
            self.expression(child)


# nodes with children that change something
WRITES = frozenset(
    "InsertIntoStatement InsertIntoDir CreateTableAsSelect ReplaceTableAsSelect MergeIntoTable UpdateTable DeleteFromTable CreateView CacheTable CacheTableAsSelect CreateNamespace DropTable".split()
)
# functions that read files or run code by name
REACHING = frozenset(("reflect", "java_method", "try_reflect", "read_files"))


class ReadOnly:
    """Queries over named tables and nothing else: no commands, writes, paths, other tables or table functions reach the session."""

    def __init__(self, spark: SparkSession, root: str, names: tuple[str, ...] = READ_ONLY):
        self._own, self.names = read_only_session(spark, root, names), frozenset(names)

    def sql(self, text: str) -> DataFrame:
        try:
            plan = self._own._jsparkSession.sessionState().sqlParser().parsePlan(text)
        except Exception as e:  # noqa: BLE001
            raise PermissionError(f"not a query: {str(e).splitlines()[0][:200]}") from None
        try:
            _Reads(self.names).plan(plan)
        except SqlRejected as e:
            raise PermissionError(str(e)) from None
        return self._own.sql(text)


def _from_column(plan: JavaObject, column: JavaObject) -> bool:
    """Whether a column of an analysed plan is made of a table's columns, in every branch of a union and through every rename."""
    kind, wanted = str(plan.nodeName()), column.exprId().toString()
    children = _seq(plan.children().toIndexedSeq())
    if kind == "View" or not children:
        return kind != "OneRowRelation"
    if kind in ("Union", "Intersect", "Except"):
        place = [c.exprId().toString() for c in _seq(plan.output().toIndexedSeq())].index(wanted)
        return all(_from_column(c, c.output().apply(place)) for c in children)
    made = {"Project": "projectList", "Aggregate": "aggregateExpressions", "Window": "windowExpressions"}.get(kind)
    for e in _seq(getattr(plan, made)().toIndexedSeq()) if made else []:
        if e.exprId().toString() == wanted and _kind(e) == "Alias":
            read = _seq(e.child().references().toIndexedSeq())
            return any(_from_column(c, r) for r in read for c in children if c.outputSet().contains(r))
    return any(_from_column(c, column) for c in children if c.outputSet().contains(column))


def validated_plan(spark: SparkSession, text: str) -> tuple[JavaObject, set[str]]:
    """The parsed plan of an allowed query, and the tables it reads."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:  # noqa: BLE001
        raise SqlRejected(f"not one query: {str(e).splitlines()[0][:200]}") from None
    walk = _Walk()
    walk.plan(plan)
    root = plan
    while str(root.nodeName()) in ("Sort", "GlobalLimit", "LocalLimit", "Offset"):
        root = root.child()
    if str(root.nodeName()) not in ROOTS:
        raise SqlRejected("the query is not a SELECT")
    if not walk.tables:
        raise SqlRejected("the query reads no table")
    return plan, walk.tables


def _limit(plan: JavaObject) -> int | None:
    while str(plan.nodeName()) in ("GlobalLimit", "Offset"):
        if str(plan.nodeName()) == "GlobalLimit":
            text = str(plan.limitExpr().toString())
            if not re.fullmatch(r"\d+", text) or int(text) <= 0:
                raise SqlRejected("the limit is not a positive number")
            return int(text)
        plan = plan.child()
    return None


def guarded(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The result of an allowed query over the given tables, of which it sees the allowed columns only; at most 100 rows."""
    plan, used = validated_plan(spark, text)
    wanted = _limit(plan)
    # a session of its own sees these views and nothing else
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    for name in used:
        visible = tables[name].select(*[c for c in TABLES[name] if c in tables[name].columns])
        rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(
            own._jsparkSession, visible._jdf.queryExecution().analyzed()
        )
        rows.createOrReplaceTempView(name)
    try:
        out = own.sql(_UNQUALIFIED.sub(lambda m: m["kept"] or "", text))
    except AnalysisException as e:
        raise SqlRejected(f"the query does not fit the tables: {str(e).splitlines()[0][:200]}") from None
    if {c.lower() for c in out.columns} != RESULT or len(out.columns) != len(RESULT):
        raise SqlRejected(f"the result's columns are not {sorted(RESULT)}")
    analysed = out._jdf.queryExecution().analyzed()
    value = next(c for c in _seq(analysed.output().toIndexedSeq()) if str(c.name()).lower() == "value")
    if not _from_column(analysed, value):
        raise SqlRejected("value does not come from a column")
    return out.limit(min(wanted or MAX_ROWS, MAX_ROWS))


#: What a guarded query may take.
SECONDS = 5.0


def run_with_timeout(df: DataFrame, seconds: float = SECONDS) -> list:
    """The rows of a capped result; its jobs are cancelled after the timeout."""
    context, group = df.sparkSession.sparkContext, uuid.uuid4().hex
    context.setJobGroup(group, "guarded query", interruptOnCancel=True)
    timer = threading.Timer(seconds, context.cancelJobGroup, [group])
    timer.start()
    try:
        return df.collect()
    finally:
        timer.cancel()
        context._jsc.clearJobGroup()
