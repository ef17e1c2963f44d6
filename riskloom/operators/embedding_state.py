"""Vectors kept in step with their texts: new, changed and gone items found by content.

The vectors lie in folders by hash of the id; a manifest names the valid folder of each
(as bucket/buckets).
A refresh compares two narrow tables of (id, content hash), embeds what is new or changed,
writes the touched buckets anew and then names them. Untouched buckets are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from riskloom.operators import embedding
from riskloom.session import scratch_path
from riskloom.sources import sinks

BUCKETS = 256
NEW, CHANGED, GONE, SAME = "new", "changed", "gone", "same"


def content_hash(text: Column, version: str = "") -> Column:
    """Hash of a text and of the version of what embeds it."""
    return F.sha2(F.concat(F.lit(version + "\n"), text), 256)


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def compare(items: DataFrame, done: DataFrame, id_col: str) -> DataFrame:
    """Full comparison of two states, both ``(id, content_sha256)``: id and change."""
    new, old = items.alias("new"), done.alias("old")
    joined = new.join(old, F.col(f"new.{id_col}") == F.col(f"old.{id_col}"), "full")
    change = (
        F.when(F.col("old.content_sha256").isNull(), NEW)
        .when(F.col("new.content_sha256").isNull(), GONE)
        .when(F.col("new.content_sha256") != F.col("old.content_sha256"), CHANGED)
        .otherwise(SAME)
    )
    return joined.select(F.coalesce(f"new.{id_col}", f"old.{id_col}").alias(id_col), change.alias("change"))


def current(spark: SparkSession, root: str, schema: T.StructType, buckets: list[int] | None = None) -> DataFrame:
    """The valid vectors, of all buckets or of some; no rows before the first refresh."""
    folders = sinks.published(spark, root)
    wanted = [path for b, path in folders.items() if buckets is None or int(b.partition("/")[0]) in set(buckets)]
    return spark.read.schema(schema).parquet(*wanted) if wanted else spark.createDataFrame([], schema)


def state_schema(items: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> T.StructType:
    """Columns of the stored vectors: those that ``embed`` gives and the content hash."""
    return T.StructType([*embed(items.limit(0)).schema.fields, T.StructField("content_sha256", T.StringType())])


def refresh(items: DataFrame, root: str, embed: Callable[[DataFrame], DataFrame], *, id_col: str = "id",
            text_col: str = "text", version: str = "", buckets: int = BUCKETS) -> DataFrame:
    """Bring the vectors below ``root`` in step with ``items``; gives ``(id, change)`` of every item.

    New and changed texts are embedded, vectors of items that are gone or have become too
    short to be embedded are left out, all others stay as they are. Another ``version``
    embeds everything anew. The number of buckets is that of the first refresh. Items without an id
    are left out; an id that occurs twice ends the refresh, as it could not be told which
    text holds. A refresh that fails leaves the vectors as they were. One runs at a time.
    """
    spark = items.sparkSession
    usable = items.where(F.col(id_col).isNotNull() & embedding.long_enough(F.col(text_col)))
    hashed = usable.select(id_col, content_hash(F.col(text_col), version).alias("content_sha256"))
    schema = state_schema(usable, embed)
    folders = sinks.published(spark, root)
    if folders:
        buckets = int(next(iter(folders)).partition("/")[2])
    known = current(spark, root, schema).select(id_col, "content_sha256")
    path = scratch_path(spark, "embedding-changes")
    compare(hashed, known, id_col).withColumn("bucket", _bucket(F.col(id_col), buckets)).write.parquet(path)
    changes = spark.read.parquet(path)
    twice = changes.groupBy(id_col).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{id_col} {twice[0][0]} occurs more than once")
    moved = changes.where(F.col("change") != SAME)
    touched = [r["bucket"] for r in moved.select("bucket").distinct().collect()]  # at most ``buckets``
    if touched:
        kept = current(spark, root, schema, touched).join(changes.where(F.col("change") == SAME), id_col, "left_semi")
        todo = usable.join(moved.where(F.col("change") != GONE), id_col, "left_semi")
        made = embed(todo).withColumn("content_sha256", content_hash(F.col("text_content"), version))
        target = f"{root}/vectors-{uuid.uuid4().hex}"
        rows = kept.unionByName(made).withColumn("bucket", _bucket(F.col(id_col), buckets))
        sinks.write_table(rows, target, partition_by=["bucket"], mode="error")
        written = changes.where(F.col("change") != GONE).where(F.col("bucket").isin(touched)).select("bucket").distinct()
        filled = {f"{r['bucket']}/{buckets}": f"{target}/bucket={r['bucket']}" for r in written.collect()}
        untouched = {b: p for b, p in folders.items() if int(b.partition("/")[0]) not in set(touched)}
        sinks.publish(spark, root, untouched | filled)
    return changes.select(id_col, "change")
