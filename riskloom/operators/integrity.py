"""Joins that keep or report rows by the presence of a key elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def keep_known(df: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose key exists among the parents."""
    return df.join(parents.select(key), key, "left_semi")


def rejects(df: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose key is missing among the parents or NULL."""
    return df.join(parents.select(key), key, "left_anti")


def reject_counts(df: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows per unknown key. Rows are counted per key before anything is joined."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return rejects(counts, parents, key)


def pending(df: DataFrame, done: DataFrame, key: str, done_key: str | None = None,
            limit: int | None = None) -> DataFrame:
    """Items not done yet, in key order; the order matters only where a limit is set."""
    keys = done.select(F.col(done_key or key).alias(key))
    left = df.join(keys, key, "left_anti")
    return left if limit is None else left.orderBy(key).limit(limit)
