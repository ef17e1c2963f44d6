"""Data-quality checks; each gives rows ``(check, passed, value, detail)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _result(df: DataFrame, check: str, passed: Column, value: Column, detail: str) -> DataFrame:
    return df.select(
        F.lit(check).alias("check"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        value.cast("double").alias("value"),
        F.lit(detail).alias("detail"),
    )


def all_checks(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def row_count(df: DataFrame, name: str, low: int | None = None, high: int | None = None,
              exact: int | None = None) -> DataFrame:
    """Row count strictly between two bounds, or equal to a given count."""
    n = F.col("n")
    tests = []
    if exact is not None:
        tests.append(n == exact)
    if low is not None:
        tests.append(n > low)
    if high is not None:
        tests.append(n < high)
    passed = reduce(lambda a, b: a & b, tests, F.lit(True))
    counted = df.agg(F.count(F.lit(1)).alias("n"))
    return _result(counted, f"rows:{name}", passed, n, "row count")


def unique_key(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """No key occurs twice; the value counts rows beyond the first of their key."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    surplus = groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))
    s = F.col("surplus")
    return _result(surplus, f"unique:{name}", s == 0, s, ",".join(keys))


def foreign_key(df: DataFrame, parents: DataFrame, name: str, key: str,
                parent_key: str | None = None) -> DataFrame:
    """Every row has a parent; the value counts rows that have none.

    Rows are counted per key first, so that the join meets each key once.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    known = parents.select(F.col(parent_key or key).alias(key))
    orphans = counts.join(known, key, "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("orphans")
    )
    o = F.col("orphans")
    return _result(orphans, f"fk:{name}", o == 0, o, key)


def coverage(df: DataFrame, dimension: DataFrame, name: str, code: str) -> DataFrame:
    """At least one code resolves; the value counts distinct codes that do."""
    codes = df.select(code).filter(F.col(code).isNotNull()).distinct()
    found = codes.join(dimension.select(code), code, "left_semi").agg(
        F.count(F.lit(1)).alias("found")
    )
    f = F.col("found")
    return _result(found, f"coverage:{name}", f > 0, f, code)


def min_distinct(df: DataFrame, name: str, column: str, at_least: int) -> DataFrame:
    """The column takes at least so many distinct values."""
    counted = df.agg(F.countDistinct(column).alias("n"))
    n = F.col("n")
    return _result(counted, f"distinct:{name}", n >= at_least, n, column)


def date_range(df: DataFrame, name: str, column: str, first_year: int,
               last_date: str | None = None) -> DataFrame:
    """Dates start no earlier than a year and end no later than a date (or today)."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    latest = F.current_date() if last_date is None else F.lit(last_date).cast("date")
    passed = (F.year("lo") >= first_year) & (F.col("hi") <= latest)
    span = F.datediff("hi", "lo")
    return _result(ends, f"dates:{name}", passed, span, column)


def peak_above(df: DataFrame, name: str, column: str, threshold: float) -> DataFrame:
    """The largest value of the column exceeds a threshold."""
    peak = df.agg(F.max(column).alias("peak"))
    p = F.col("peak")
    return _result(peak, f"peak:{name}", p > threshold, p, column)


def column_rules(df: DataFrame, name: str, *, not_null: list[str] = (),
                 max_length: dict[str, int] | None = None,
                 domain: dict[str, Column] | None = None) -> DataFrame:
    """Checks that look at one row at a time, all in a single pass over the table.

    ``not_null`` lists required columns, ``max_length`` the longest text per column,
    and ``domain`` the condition valid values satisfy. The value counts violations.
    """
    rules: list[tuple[str, str, Column]] = []
    for column in not_null:
        rules.append((f"not_null:{name}.{column}", "missing values", F.col(column).isNull()))
    for column, limit in (max_length or {}).items():
        rules.append((f"length:{name}.{column}", f"longer than {limit}", F.length(column) > limit))
    for column, valid in (domain or {}).items():
        rules.append((f"domain:{name}.{column}", "outside the domain", ~valid))
    counts = df.agg(*[F.count_if(bad).alias(f"r{i}") for i, (_, _, bad) in enumerate(rules)])
    rows = [
        F.struct(
            F.lit(check).alias("check"),
            (F.col(f"r{i}") == 0).alias("passed"),
            F.col(f"r{i}").cast("double").alias("value"),
            F.lit(detail).alias("detail"),
        )
        for i, (check, detail, _) in enumerate(rules)
    ]
    return counts.select(F.inline(F.array(*rows)))


def domain_violations(df: DataFrame, column: str, valid: Column) -> DataFrame:
    """The values outside a domain and how often each occurs."""
    return df.filter(~valid).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))


def vector_width(df: DataFrame, name: str, column: str, width: int) -> DataFrame:
    """Every vector has the declared width; the value counts vectors that have not."""
    counted = df.agg(F.count_if(F.coalesce(F.size(column), F.lit(-1)) != width).alias("bad"))
    b = F.col("bad")
    return _result(counted, f"width:{name}", b == 0, b, column)
