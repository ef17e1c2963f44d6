"""Top-k, per-group top-k and positions that hold up with very large groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows; each task keeps only ``k`` before the merge.

    ``order`` must end in a unique key, so that the result is the same on every run.
    """
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int,
                    rank_name: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group.

    Spark plans the row-number filter as a group limit before the shuffle, so a hot
    group sends at most ``k`` rows per input task.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_name, F.row_number().over(window)).filter(F.col(rank_name) <= k)


def number_rows(df: DataFrame, group: list[str], slices: dict[str, Column],
                order: list[Column], name: str = "position", weight: str | None = None) -> DataFrame:
    """Position (from 0) of every row in its group, without one task per large group.

    ``slices`` cut a group into consecutive pieces, coarse to fine: each is a non-null
    expression that never decreases along the order within the slice above it. Rows are
    counted per slice (combined before the shuffle), the running totals of those counts
    give each slice its offset, and only rows of one slice are sorted together.
    ``order`` sorts the rows of a finest slice. A row counts as many positions as its
    ``weight`` column says, or one.
    """
    keys = list(slices)
    places = F.lit(1).cast("long") if weight is None else F.col(weight)
    sliced = df.withColumns(slices)
    counts = sliced.groupBy(*group, *keys).agg(F.sum(places).alias("_n"))
    if len(keys) > 1:
        # One shuffle serves both the totals and the running sums of the last level.
        counts = counts.repartition(*group, *keys[:-1])

    offsets = None
    for depth in range(1, len(keys) + 1):
        held, level = keys[: depth - 1], keys[depth - 1]
        before = (
            Window.partitionBy(*group, *held)
            .orderBy(level)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        totals = counts if depth == len(keys) else (
            counts.groupBy(*group, *held, level).agg(F.sum("_n").alias("_n"))
        )
        step = totals.select(
            *group, *held, level,
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_step"),
        )
        if offsets is None:
            offsets = step.withColumnRenamed("_step", "_offset")
        else:
            offsets = step.join(offsets, [*group, *held]).select(
                *group, *held, level, (F.col("_offset") + F.col("_step")).alias("_offset")
            )

    inside = Window.partitionBy(*group, *keys).orderBy(*order)
    before = F.row_number().over(inside) - 1 if weight is None else F.coalesce(
        F.sum(places).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    return (
        sliced.join(offsets, [*group, *keys])
        .withColumn(name, F.col("_offset") + before)
        .drop(*keys, "_offset")
    )


def surrogate_ids(df: DataFrame, key: str, name: str = "id", width: int = 1_000_000) -> DataFrame:
    """Dense ids 1, 2, 3 … in the order of a unique whole-number key.

    A slice spans ``width`` key values and so holds at most ``width`` rows; the running
    totals that one task adds up are those of the coarse slices only.
    """
    value = F.col(key)
    slices = {
        "_coarse": F.floor(value / (width * 1000.0)),
        "_fine": F.floor(value / float(width)),
    }
    numbered = number_rows(df, [], slices, [value.asc()], name="_position")
    return numbered.withColumn(name, F.col("_position") + 1).drop("_position")


def content_ids(df: DataFrame, name: str = "id") -> DataFrame:
    """Dense ids that depend on the rows alone, not on files or input splits.

    Rows are numbered in the order of a hash, and rows of one hash by their values. Equal
    rows take consecutive ids: they travel as one row and a count, so however often a row
    occurs, no task sorts its copies.
    """
    columns = df.columns
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
    folded = df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias("_copies"))
    top = F.shiftright(hashed, 44)
    numbered = number_rows(
        folded, [], {"_coarse": F.shiftright(top, 8), "_fine": top},
        [hashed.asc(), *[F.col(f"`{c}`").asc() for c in columns]], name="_first", weight="_copies",
    )
    copies = F.explode(F.sequence(F.col("_first") + 1, F.col("_first") + F.col("_copies")))
    return numbered.select(*[F.col(f"`{c}`") for c in columns], copies.alias(name))
