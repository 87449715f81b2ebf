"""Read-only SQL over one dataset."""

from __future__ import annotations

import uuid

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from framegauge.sources import load_dataset

_READ_ONLY = "Only read-only SELECT/WITH queries are allowed in Stage 1."
# Functions that run arbitrary code, and plan nodes that are
# commands, writes or external programs although the text starts like a query.
_CODE_FUNCTIONS = {"reflect", "java_method", "try_reflect"}
_FORBIDDEN_NODES = (
    "Insert",
    "Command",
    "ScriptTransformation",
    "MergeInto",
    "DeleteFrom",
    "UpdateTable",
    "CreateTable",
    "ReplaceTable",
    "CompoundBody",
)
_SUBQUERIES = {
    "Exists",
    "FunctionTableSubqueryArgumentExpression",
    "LateralSubquery",
    "ListQuery",
    "ScalarSubquery",
}
_PLACEHOLDER = "{dataset}"


def query_dataset(df: DataFrame, sql: str) -> DataFrame:
    """Run a SELECT/WITH statement in which ``{dataset}`` stands for ``df``.

    The result is a lazy DataFrame.  The dialect is Spark SQL.
    """
    require_read_only_prefix(sql)
    spark = df.sparkSession
    view = f"dataset_{uuid.uuid4().hex}"
    statement = _statement(sql).replace(_PLACEHOLDER, view)
    require_read_only_plan(spark, statement)
    df.createOrReplaceTempView(view)
    try:
        # The view is resolved while the statement is analysed.
        return spark.sql(statement)
    finally:
        spark.catalog.dropTempView(view)


def query_parquet(spark: SparkSession, path: str, sql: str) -> DataFrame:
    """The same over a Parquet path; the text is checked before the path."""
    require_read_only_prefix(sql)
    return query_dataset(load_dataset(spark, path), sql)


def _statement(sql: str) -> str:
    return sql.strip().rstrip(";").strip()


def require_read_only_prefix(sql: str) -> None:
    if not _statement(sql).lower().startswith(("select ", "with ")):
        raise ValueError(_READ_ONLY)


def require_read_only_plan(spark: SparkSession, statement: str) -> None:
    """Reject what Spark's own parser reads as more than a query."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except ParseException as error:
        if ";" in statement:
            raise ValueError(_READ_ONLY) from error
        raise
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if any(word in name for word in _FORBIDDEN_NODES):
            raise ValueError(_READ_ONLY)
        nodes.extend(_sequence(node.children()))
        if name == "UnresolvedWith":
            nodes.extend(relation._2() for relation in _sequence(node.cteRelations()))
        for expression in _sequence(node.expressions()):
            nodes.extend(_subqueries(expression))


def _subqueries(expression) -> list:
    """Plans nested in an expression; function names are checked on the way."""
    found, pending = [], [expression]
    while pending:
        current = pending.pop()
        kind = current.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            name = _sequence(current.nameParts())[-1].lower()
            if name in _CODE_FUNCTIONS:
                raise ValueError(_READ_ONLY)
        if kind in _SUBQUERIES:
            found.append(current.plan())
        pending.extend(_sequence(current.children()))
    return found


def _sequence(scala_seq) -> list:
    return [scala_seq.apply(i) for i in range(scala_seq.size())]
