"""Read-only SQL: fence removal, audit of statements, capped execution."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.functions import clean
from riskloom.functions.fixed_values import FORBIDDEN_WORDS
from riskloom.operators import plan_audit

# Valid inside a SELECT, yet able to write, run code or read arbitrary files.
_ALSO_REFUSED = ["MERGE", "INTO", "TRANSFORM", "REFLECT", "JAVA_METHOD", "TRY_REFLECT"]
# The format's name may be quoted, and comments may stand around the dot.
_SPACE = r"(?:\s|/\*.*?\*/|--[^\n]*\n)*+"
_PATH_TABLE = rf"(?is)\b(parquet|csv|json|orc|text|avro|xml|binaryfile|delta|iceberg)`?{_SPACE}\.{_SPACE}`"
# One statement: everything up to a semicolon that is not inside quotes. A doubled quote
# inside a text reads as the end of one text and the start of the next. The possessive
# quantifiers match without recursion, so texts may be of any length.
_STATEMENT = r"(?:[^';]++|'[^']*+(?:'|$))++"

# Fixed wording of the messages.
EMPTY = "Empty SQL query"
WRONG_START = "Only SELECT queries allowed, got: "
FORBIDDEN = "Dangerous keyword detected: "

DEFAULT_CAP = 100


def strip_fences(sql: Column) -> Column:
    """Remove Markdown code fences and surrounding space."""
    without_open = F.regexp_replace(clean.strip(sql), r"(?m)^```(sql)?\s*", "")
    return clean.strip(F.regexp_replace(without_open, r"(?m)\s*```$", ""))


def _statement_error(statement: Column, mode: str) -> Column:
    upper = F.upper(statement)
    first_word = F.regexp_extract(statement, r"^\s*([A-Za-z_]+|\S)", 1)
    openers = ["SELECT"] if mode == "substring" else ["SELECT", "WITH"]
    wrong_start = F.when(
        ~F.upper(first_word).isin(*openers),
        F.concat(F.lit(WRONG_START), first_word),
    )
    words = FORBIDDEN_WORDS if mode == "substring" else FORBIDDEN_WORDS + _ALSO_REFUSED
    edge = "" if mode == "substring" else r"\b"
    hits = [
        F.when(upper.rlike(rf"{edge}{word}{edge}"), F.lit(FORBIDDEN + word))
        for word in words
    ]
    # Most texts hold no such word, and one look settles it.
    hit = F.when(upper.rlike(rf"{edge}({'|'.join(words)}){edge}"), F.coalesce(*hits))
    by_path = F.when(statement.rlike(_PATH_TABLE), F.lit("Reading files by path is not allowed"))
    return F.coalesce(wrong_start, hit) if mode == "substring" else F.coalesce(wrong_start, hit, by_path)


def sql_error(sql: Column, mode: str = "word") -> Column:
    """Why a SQL text is refused, or NULL if it is accepted.

    ``substring`` finds forbidden words anywhere, also inside names such as
    ``created_at``; ``word`` finds them as whole words only, accepts a leading WITH, and
    refuses some further constructs that Spark would run inside a SELECT.
    """
    if mode not in ("word", "substring"):
        raise ValueError(f"unknown mode: {mode}")
    statements = F.filter(
        F.regexp_extract_all(F.coalesce(sql, F.lit("")), F.lit(_STATEMENT), F.lit(0)),
        lambda s: s.rlike(r"\S"),
    )
    errors = F.filter(F.transform(statements, lambda s: _statement_error(s, mode)), lambda e: e.isNotNull())
    return F.when(F.size(statements) == 0, F.lit(EMPTY)).otherwise(F.try_element_at(errors, F.lit(1)))


def audit_sql(df: DataFrame, column: str, mode: str = "word") -> DataFrame:
    """Add ``is_safe`` and ``error`` to a table of SQL texts, such as a query log."""
    return df.withColumn("error", sql_error(F.col(column), mode)).withColumn(
        "is_safe", F.col("error").isNull()
    )


def cap(df: DataFrame, rows: int | None = DEFAULT_CAP) -> DataFrame:
    """At most so many rows, or all for None; the limit is part of the plan, whatever the text says."""
    return df if rows is None else df.limit(rows)


class UnsafeSql(ValueError):
    """A SQL text was refused."""


Tables = dict[str, DataFrame] | Callable[[SparkSession], dict[str, DataFrame]]


def run_select(spark: SparkSession, sql: str, tables: Tables | None = None,
               rows: int | None = DEFAULT_CAP, mode: str = "word") -> DataFrame:
    """Check one SQL text, run it on the given tables and cap the result.

    A function that opens the tables in the session it is given gets a session of its
    own: the text then sees no views but these, and cannot name files as tables. Tables
    given as such belong to a session already and become temporary views of it. Dates and
    times come back as ISO text. The check is a policy, not a security boundary; the
    session should only hold read access to its data.

    Mode ``plan`` looks at what Spark's parser makes of the text instead of at its words:
    it must be a query that names the given tables and Spark's own functions only.
    """
    text = spark.range(1).select(strip_fences(F.lit(sql)).alias("sql"))
    checked = (text.withColumn("error", F.lit(None)) if mode == "plan" else audit_sql(text, "sql", mode)).first()
    if checked["error"] is not None:
        raise UnsafeSql(f"Unsafe SQL: {checked['error']}")
    if callable(tables):
        own = spark.newSession()
        for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
            own.conf.set(key, spark.conf.get(key))
        own.conf.set("spark.sql.runSQLOnFiles", "false")
        spark, tables = own, tables(own)
    if mode == "plan" and (error := plan_audit.PlanAudit(spark, tables or {}).error(checked["sql"])):
        raise UnsafeSql(f"Unsafe SQL: {error}")
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    return clean.iso_frame(cap(spark.sql(re.sub(r";\s*$", "", checked["sql"])), rows))
