"""Readers for exported sheets and the panel file. All cells are read as text."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom import schemas
from riskloom.functions import clean, fixed_values as fv

ROW = "_row"


def read_sheet(spark: SparkSession, path: str, columns: list[str] | None = None,
               multi_line: bool = False) -> DataFrame:
    """A sheet with a heading row, exported as CSV (quotes doubled inside quotes).

    Headings are normalised. With ``columns`` the headings are not trusted and columns
    are taken by position. ``multi_line`` allows line breaks inside cells, at the price
    of reading each file in one task.
    """
    reader = spark.read.options(header=True, escape='"', multiLine=multi_line)
    if columns is not None:
        return reader.schema(schemas.text_schema(columns)).csv(path)
    return clean.normalize_headers(reader.csv(path))


def read_numbered_sheet(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_sheet``, but with the original headings and a row number.

    The number grows with the row's place in the sheet, which "first" and "last value
    wins" rules need. Rows of a sheet in several files follow the order of file names.
    """
    sheet = spark.read.options(header=True, escape='"').csv(path)
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return sheet.withColumn(ROW, place)


def read_matrix(spark: SparkSession, path: str, header_row: int = 1) -> tuple[DataFrame, list[str | None]]:
    """A sheet without headings whose row ``header_row`` describes the columns.

    Gives all rows as text and the descriptions. Only the rows up to the descriptions
    reach the driver, to learn the width of the sheet, which a title row need not have;
    data rows are told apart later by their date.
    """
    top = [r[0] for r in spark.read.text(path).take(header_row + 1)]
    cells = [next(csv.reader([line]), []) for line in top]
    headings = [c or None for c in cells[header_row]] if len(cells) > header_row else []
    width = max((len(row) for row in cells), default=1)
    columns = schemas.text_schema([f"_c{i}" for i in range(width)])
    rows = spark.read.schema(columns).options(header=False, escape='"').csv(path)
    return rows, headings


def _panel_headings(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).first()
    return next(csv.reader([first[0]]), []) if first else fv.PANEL_HEADINGS


def _panel_by_heading(lines: DataFrame, headings: list[str]) -> DataFrame:
    """Panel rows without heading lines, columns named by their fields.

    Every file repeats the heading line. One that differs stops the job, since its
    columns would be taken for others.
    """
    fields = schemas.panel_layout(headings)
    cells = [F.lower(clean.strip(F.col(f))) for f in fields]
    names = [h.strip().lower() for h in headings]
    known = sorted({h.lower() for h in fv.PANEL_HEADINGS})
    same = F.lit(True)
    for cell, name in zip(cells, names):
        same = same & (F.coalesce(cell, F.lit("")) == name)
    keys = [F.col(f) for f in ("company_number", "year", "month")]
    is_heading = F.coalesce(
        F.exists(F.array(*keys), lambda c: F.lower(clean.strip(c)).isin(*known)), F.lit(False)
    )
    other = F.raise_error(F.concat(F.lit("panel file with other headings: "), F.concat_ws(",", *fields)))
    rows = lines.filter(~F.when(is_heading, F.when(same, F.lit(True)).otherwise(other.cast("boolean")))
                        .otherwise(F.lit(False)))
    return rows.select(*[
        F.col(f) if f in fields else F.lit(None).cast("string").alias(f) for f in schemas.PANEL_FIELDS
    ])


def read_panel_csv(spark: SparkSession, path: str) -> DataFrame:
    """The monthly risk panel, read in parallel splits.

    Columns go by their headings, whatever their order; a field without a column is
    NULL. All files of a folder share one heading line.
    """
    headings = _panel_headings(spark, path)
    layout = schemas.text_schema(schemas.panel_layout(headings))
    return _panel_by_heading(spark.read.schema(layout).csv(path), headings)


def stream_panel_csv(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """New panel files of a folder as a stream; all files share one heading line."""
    headings = _panel_headings(spark, path)
    layout = schemas.text_schema(schemas.panel_layout(headings))
    lines = spark.readStream.schema(layout).option("maxFilesPerTrigger", max_files).csv(path)
    return _panel_by_heading(lines, headings)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A database table; pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` to read it in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
