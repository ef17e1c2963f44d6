"""Table sinks: full refresh in one write, row counts taken on the way."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

MAX_RECORDS_PER_FILE = 5_000_000


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the declared schema in its order; absent ones become NULL."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def with_audit_columns(df: DataFrame, *names: str) -> DataFrame:
    """Add load timestamps (UTC, without zone)."""
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")
    return df.withColumns({n: now for n in names})


def write_table(df: DataFrame, target: str, *, mode: str = "overwrite",
                partition_by: list[str] | None = None, sort_by: list[str] | None = None,
                cluster_by: list[str] | None = None,
                catalog: bool = False, buckets: tuple[int, str] | None = None) -> int:
    """Write a table as Parquet and return the number of rows written.

    The count is observed during the write, not computed by a second job. Partitioned
    tables are rebalanced first: files get an even size, a small partition is one file
    and a huge one is split over many tasks. ``cluster_by`` gives every file a range of
    the given columns, so a lookup by the first of them opens few files; later columns
    split the range of a value that has very many rows. ``buckets`` (number, key) lays a catalog
    table out by a key: joins and aggregations on it then need no shuffle.
    """
    if buckets and not catalog:
        raise ValueError("only catalog tables can be bucketed")
    out = df
    if partition_by:
        out = out.hint("rebalance", *partition_by)
    if cluster_by:
        out = out.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    if sort_by:
        out = out.sortWithinPartitions(*(partition_by or []), *sort_by)
    # Counted in the writing stage itself: a range shuffle reads its input twice, and a
    # count placed before it would be doubled.
    rows = Observation(f"rows-{uuid.uuid4().hex}")
    writer = out.observe(rows, F.count(F.lit(1)).alias("n")).write.mode(mode).option(
        "maxRecordsPerFile", MAX_RECORDS_PER_FILE
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if buckets:
        writer = writer.bucketBy(*buckets).sortBy(buckets[1])
    if catalog:
        writer.saveAsTable(target)
    else:
        writer.parquet(target)
    return rows.get["n"]


MANIFEST = "manifest"
_MANIFEST_SCHEMA = "version long, published timestamp, paths map<string,string>"


def publish(spark: SparkSession, root: str, paths: dict[str, str]) -> int:
    """Name the folders that hold the valid tables from now on; gives the version's number.

    The manifest grows by one file of one row, which appears as a whole or not at all.
    One writer publishes at a time.
    """
    last = _versions(spark, root).agg(F.max("version")).first()[0] or 0
    row = spark.createDataFrame([(last + 1, paths)], "version long, paths map<string,string>")
    row.select("version", F.current_timestamp().alias("published"), "paths").coalesce(1).write.mode("append").parquet(f"{root}/{MANIFEST}")
    return last + 1


def published(spark: SparkSession, root: str, version: int | None = None) -> dict[str, str]:
    """Folders of the valid version, or of an earlier one; none before the first."""
    rows = _versions(spark, root)
    if version is not None:
        rows = rows.filter(F.col("version") == version)
    latest = rows.orderBy(F.col("version").desc(), F.col("published").desc()).limit(1).collect()
    return dict(latest[0]["paths"]) if latest else {}


def unused_folders(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Folders that only versions before the last ``keep`` name; they may be deleted."""
    rows = _versions(spark, root).orderBy(F.col("version").desc()).collect()  # one row per refresh
    used = {path for r in rows[:keep] for path in r["paths"].values()}
    return sorted({path for r in rows[keep:] for path in r["paths"].values()} - used)


def _versions(spark: SparkSession, root: str) -> DataFrame:
    """All rows of the manifest; one without rows is made where there is none."""
    path = f"{root}/{MANIFEST}"
    spark.createDataFrame([], _MANIFEST_SCHEMA).write.mode("ignore").parquet(path)
    return spark.read.schema(_MANIFEST_SCHEMA).parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, *, mode: str = "overwrite",
               batch: int = 1000, **options: str) -> None:
    """Write a table to a database in batches; ``overwrite`` empties it and keeps its DDL."""
    (
        df.write.format("jdbc")
        .options(url=url, dbtable=table, batchsize=str(batch), truncate="true", **options)
        .mode(mode)
        .save()
    )
