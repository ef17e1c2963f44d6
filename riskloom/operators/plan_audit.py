"""Audit of SQL by the plan that Spark's own parser makes of it; nothing is run.

Only what stands in the plan counts: forbidden words inside quotes, comments and names are
harmless, and whatever is not a query, names a table that is not allowed (a file among
them) or calls a function that is not allowed is refused.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.session import scratch_path

# What a query consists of, by Spark's names. Everything else (commands, scripts, names
# made at run time, TRANSFORM) is refused.
QUERY_NODES = {
    "Aggregate", "Deduplicate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join",
    "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "PipeOperator", "Pivot", "Project",
    "Repartition", "Sample", "Sort", "SubqueryAlias", "Union", "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedRelation",
    "UnresolvedSubqueryColumnAliases", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "UnresolvedWith",
    "Unpivot", "Window", "WithWindowDefinition",
}
DYNAMIC_NAMES = {"ExpressionWithUnresolvedIdentifier", "UnresolvedIdentifier"}
# Built in, yet they run code or tell of files and users.
REFUSED_FUNCTIONS = {
    "reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length",
    "current_user", "session_user", "user",
}

EMPTY = "Empty SQL query"
NOT_A_QUERY = "Not a query: "
NO_TABLE = "Table not allowed: "
NO_FUNCTION = "Function not allowed: "
NOT_PARSED = "Not one SQL statement"

PAGE = 10_000


class _Refused(Exception):
    pass


def builtin_functions(spark: SparkSession) -> frozenset[str]:
    """Names of Spark's own functions, without those that are refused."""
    return frozenset(r[0] for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()) - REFUSED_FUNCTIONS


def _each(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


class PlanAudit:
    """Checks texts against allowed tables and functions (None: Spark's own but a few)."""

    def __init__(self, spark: SparkSession, tables: Iterable[str], functions: Iterable[str] | None = None):
        self._parser = spark._jsparkSession.sessionState().sqlParser()
        loader = self._parser.getClass().getClassLoader()
        self._subquery = loader.loadClass("org.apache.spark.sql.catalyst.expressions.PlanExpression")
        self._tables = frozenset(t.lower() for t in tables)
        self._functions = builtin_functions(spark) if functions is None else frozenset(f.lower() for f in functions)

    def error(self, sql: str | None) -> str | None:
        """Why a text is refused, or None; null and blank texts are refused as empty."""
        if sql is None or not sql.strip():
            return EMPTY
        try:
            self._plan(self._parser.parsePlan(sql.rstrip().removesuffix(";")), self._tables)
        except ParseException:
            return NOT_PARSED
        except _Refused as refused:
            return str(refused)
        return None

    def _plan(self, node, known: frozenset[str]) -> None:
        """``known``: tables that may be named here, those of WITH clauses around it among them."""
        kind = _name(node)
        if kind not in QUERY_NODES:
            raise _Refused(NOT_A_QUERY + kind)
        if kind == "UnresolvedRelation":
            parts = list(_each(node.multipartIdentifier()))
            if len(parts) != 1 or parts[0].lower() not in known or node.isStreaming():
                raise _Refused(NO_TABLE + ".".join(parts))
        elif kind == "UnresolvedTableValuedFunction":
            self._function(".".join(_each(node.name())))
        elif kind == "UnresolvedWith":
            for pair in _each(node.cteRelations()):
                own = pair._1().lower()
                self._plan(pair._2(), known | {own} if node.allowRecursion() else known)
                known = known | {own}
        for expression in _each(node.expressions()):
            self._expression(expression, known)
        for child in _each(node.children()):
            self._plan(child, known)

    def _expression(self, node, known: frozenset[str]) -> None:
        kind = _name(node)
        if kind in DYNAMIC_NAMES:
            raise _Refused(NOT_A_QUERY + kind)
        if kind == "UnresolvedFunction":
            self._function(".".join(_each(node.nameParts())))
        if self._subquery.isInstance(node):
            self._plan(node.plan(), known)
        for child in _each(node.children()):
            self._expression(child, known)

    def _function(self, name: str) -> None:
        if name.lower() not in self._functions:
            raise _Refused(NO_FUNCTION + name)


def template(sql: Column) -> Column:
    """A text with its whole numbers as 0, which changes nothing that the audit looks at.

    Digits inside names, quoted dates and fractions stay.
    """
    return F.regexp_replace(sql, r"(?<=[\s=(,<>+*])\d+(?=[\s),;]|$)", "0")


def audit_plans(df: DataFrame, column: str, tables: Iterable[str], functions: Iterable[str] | None = None) -> DataFrame:
    """Add ``plan_error`` to a table of SQL texts: why each is refused, NULL if it is accepted.

    Spark's parser lives on the driver. It sees every template once: texts that differ in
    numbers only are folded before. Templates pass in pages of 10,000 and their verdicts
    are written as a table, so the driver's memory does not grow with the log.
    """
    spark = df.sparkSession
    audit = PlanAudit(spark, tables, functions)
    path = scratch_path(spark, "plan-audit")
    schema = "sql_template string, plan_error string"
    spark.createDataFrame([], schema).write.parquet(path)
    found = df.select(template(F.col(column)).alias("t")).where("t IS NOT NULL").distinct().toLocalIterator()
    while page := list(islice(found, PAGE)):
        verdicts = [(r["t"], audit.error(r["t"])) for r in page]
        spark.createDataFrame(verdicts, schema).write.mode("append").parquet(path)
    verdicts = spark.read.schema(schema).parquet(path)
    return (
        df.join(verdicts, template(F.col(column)) == F.col("sql_template"), "left")
        .withColumn("plan_error", F.when(F.col(column).isNull(), EMPTY).otherwise(F.col("plan_error")))
        .drop("sql_template")
    )
