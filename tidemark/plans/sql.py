"""Free SQL over named tables, with a row cap, a read-only guard and plans as text."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator, Mapping
from typing import Any, NamedTuple

from py4j.java_gateway import is_instance_of
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from ..functions.staging import snapshot
from ..operators.project import within

#: Commands that only show something, by the starts of their plans' names (fixed values).
SHOWING = ("Show", "Describe")
#: Functions that call any method of the process (fixed values).
REFLECTING = ("reflect", "try_reflect", "java_method")
EXPLAIN = re.compile(r"\s*EXPLAIN(?:\s+(?:EXTENDED|CODEGEN|COST|FORMATTED|LOGICAL))?\s+", re.IGNORECASE)
MOST_ROWS = 100_000


class Result(NamedTuple):
    rows: DataFrame
    messages: list[str]
    seconds: float


def is_read_only(spark: SparkSession, sql: str) -> bool:
    """Whether a statement is known to read only: Spark's own parser takes it whole as a query, or as a command that shows something. All else is
    refused, EXECUTE IMMEDIATE, CALL, scripts and settings included, and so are queries that run programs or methods (TRANSFORM, reflect). EXPLAIN of a
    statement counts as that statement."""
    explained = EXPLAIN.match(sql)
    if explained:
        return is_read_only(spark, sql[explained.end() :])
    parser = spark._jsparkSession.sessionState().sqlParser()
    try:
        return not any(map(_acts, _nodes(spark, parser.parseQuery(sql))))
    except ParseException:
        pass
    try:
        return parser.parsePlan(sql).nodeName().startswith(SHOWING)
    except ParseException:
        return False


def _nodes(spark: SparkSession, plan: Any) -> Iterator[Any]:
    """All plans and expressions of a parsed query, those of subqueries, named tables and windows included."""
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        yield node
        below = [node.children(), node.innerChildren()]
        if is_instance_of(spark.sparkContext._gateway, node, "org.apache.spark.sql.catalyst.plans.QueryPlan"):
            below.append(node.expressions())
        if node.nodeName() == "WithWindowDefinition":
            below.append(node.windowDefinitions().values().toSeq())
        waiting += [some.apply(k) for some in below for k in range(some.size())]


def _acts(node: Any) -> bool:
    """Whether a part of a query runs a program or a method, or a function whose name is only known later."""
    kind = node.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        return node.nameParts().last().lower() in REFLECTING
    return kind in ("ScriptTransformation", "ExpressionWithUnresolvedIdentifier")


def _named(spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def query(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], args: Mapping[str, Any] | None = None, read_only: bool = False) -> DataFrame:
    """The rows of one statement, not capped. PermissionError if it isn't a read and must be."""
    if read_only and not is_read_only(spark, sql):
        raise PermissionError("this connection only reads")
    _named(spark, tables)
    return spark.sql(sql, args=dict(args or {}))


def run(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], max_rows: int = 1000, args: Mapping[str, Any] | None = None, read_only: bool = False) -> Result:
    """At most max_rows rows (100,000 at most, else ValueError), with a message when that many came. The statement runs once: its rows are written to
    the shared folder, so that a lost executor can't change which ones they are."""
    began = time.monotonic()
    limit = within(max_rows, MOST_ROWS)
    rows = snapshot(query(spark, sql, tables, args, read_only).limit(limit))
    capped = rows.count() >= limit
    return Result(rows, [f"the first {limit} rows; there may be more"] * capped, time.monotonic() - began)


def explain(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The formatted plan as rows."""
    _named(spark, tables)
    return spark.sql(f"EXPLAIN FORMATTED {sql}")
