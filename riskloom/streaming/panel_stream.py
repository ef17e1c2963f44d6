"""Incremental load of the risk panel, settled as it is written.

Every month of the panel is one folder, and a manifest names the valid ones. A batch reads
the months that it touches, settles them together with its own rows and writes them as new
folders; the others stay. Settling the same rows again changes nothing, so a batch may be
run twice, and a lost checkpoint costs time but no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from riskloom import schemas
from riskloom.functions import fixed_values as fv
from riskloom.plans import loads
from riskloom.session import scratch_path
from riskloom.sources import sheets, sinks

_COLUMNS = [*loads.PANEL_KEY, "company_number", *fv.PANEL_MEASURES]
# The folders repeat year and month, which stay in the files as well.
_FOLDER = ["part_year", "part_month"]


def _schema() -> T.StructType:
    kinds = {f.name: f.dataType for f in schemas.RISK_INDICATORS.fields} | {"company_number": T.LongType()}
    return T.StructType([T.StructField(n, kinds[n]) for n in _COLUMNS])


def _read(spark: SparkSession, folders: Iterable[str]) -> DataFrame:
    paths = sorted(folders)
    return spark.read.schema(_schema()).parquet(*paths) if paths else spark.createDataFrame([], _schema())


def settle_batch(batch: DataFrame, known_companies: DataFrame, target: str) -> None:
    """Clean one batch and bring the months that it touches up to date.

    Readers see all of a batch or nothing of it. One writer at a time. Folders that no
    longer count are listed by ``sinks.unused_folders``.
    """
    spark = batch.sparkSession
    path = scratch_path(spark, "panel-batch")
    loads.risk_panel(batch, known_companies).select(*_COLUMNS).write.parquet(path)
    rows = spark.read.schema(_schema()).parquet(path)
    touched = [(r["year"], r["month"]) for r in rows.select("year", "month").distinct().collect()]  # calendar months
    if not touched:
        return
    valid = sinks.published(spark, target)
    before = _read(spark, [valid[f"{y}-{m}"] for y, m in touched if f"{y}-{m}" in valid])
    settled = loads.one_row_per_month(before.unionByName(rows)).select(
        *_COLUMNS, F.col("year").alias(_FOLDER[0]), F.col("month").alias(_FOLDER[1])
    )
    folder = f"{target.rstrip('/')}/months-{uuid.uuid4().hex}"
    sinks.write_table(settled, folder, partition_by=_FOLDER, sort_by=["u3_company_number"], mode="error")
    fresh = {f"{y}-{m}": f"{folder}/{_FOLDER[0]}={y}/{_FOLDER[1]}={m}" for y, m in touched}
    sinks.publish(spark, target, valid | fresh)


def stream_panel(spark: SparkSession, source: str, known_companies: DataFrame, target: str,
                 checkpoint: str, max_files: int = 100) -> StreamingQuery:
    """Load all files that have arrived since the last run, then stop."""
    return (
        sheets.stream_panel_csv(spark, source, max_files)
        .writeStream.foreachBatch(lambda batch, _: settle_batch(batch, known_companies, target))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stored_panel(spark: SparkSession, target: str, years: Iterable[int] | None = None) -> DataFrame:
    """What the stream has stored so far, as the batch load would have it; a plain scan.

    The lowest company number of a month wins, in whatever order files came. With
    ``years`` only their folders are listed.
    """
    wanted = None if years is None else {str(y) for y in years}
    folders = sinks.published(spark, target)
    return _read(spark, [path for month, path in folders.items() if wanted is None or month.rpartition("-")[0] in wanted])
