"""Reshaping of macro sheets: headings to fields, wide to long, long to wide."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions import clean


def field_of_heading(heading: str | None, patterns: Iterable[tuple[str, str]]) -> str | None:
    """Field of the first pattern contained in one heading (headings are metadata)."""
    if heading is None:
        return None
    lowered = str(heading).strip().lower()
    return next((field for pattern, field in patterns if pattern.lower() in lowered), None)


def _position(column_index: int, row: Column) -> Column:
    """Order of a cell: by column, then by row, for any number of columns."""
    return F.struct(F.lit(column_index).alias("column"), row.alias("row"))


def unpivot_sheet(df: DataFrame, date: Column, headings: list[str], patterns,
                  row: str) -> DataFrame:
    """Sheet with one date column to ``(date, series, value, position)``.

    ``headings`` are the descriptions of ``df.columns`` in order; columns that match no
    pattern are dropped. Cells stay text until they are cleaned here.
    """
    cells = []
    for index, (name, heading) in enumerate(zip(df.columns, headings)):
        field = field_of_heading(heading, patterns)
        if field is not None:
            cells.append(_cell(date, field, F.col(f"`{name}`"), index, F.col(row)))
    return _explode_cells(df, cells)


def unpair_sheet(df: DataFrame, headings: list[str], patterns, row: str) -> DataFrame:
    """Sheet of adjacent (date, value) columns to ``(date, series, value, position)``.

    The heading of the value column names the series, and its dates stand in the column
    to the left. After a match the next column is skipped. Dates may be quarters.
    """
    cells = [
        _cell(clean.period_date(F.col(f"`{df.columns[date]}`")), field, F.col(f"`{df.columns[value]}`"), value, F.col(row))
        for date, value, field in paired_columns(headings, patterns)
    ]
    return _explode_cells(df, cells)


def paired_columns(headings: list[str], patterns) -> list[tuple[int, int, str]]:
    """Place of the date, place of the value and field of each series in a paired sheet."""
    fields = [field_of_heading(h, patterns) for h in headings]
    taken: list[int] = []
    for column, field in enumerate(fields):
        # A column right after a match is that match's partner.
        if field is not None and column - 1 not in taken[-1:]:
            taken.append(column)
    return [(max(c - 1, 0), c, fields[c]) for c in taken]


def _cell(date: Column, field: str, value: Column, index: int, row: Column) -> Column:
    return F.struct(
        date.alias("date"),
        F.lit(field).alias("series"),
        clean.to_double(value).alias("value"),
        _position(index, row).alias("position"),
    )


def _explode_cells(df: DataFrame, cells: list[Column]) -> DataFrame:
    if not cells:
        raise ValueError("no heading matches a known series")
    return df.select(F.inline(F.array(*cells))).filter(F.col("date").isNotNull())


def long_to_wide(df: DataFrame, fields: list[str], keep: str, key: str = "date",
                 series: str = "series", value: str = "value",
                 position: str = "position", since: str | None = None) -> DataFrame:
    """One row per key and one column per field.

    Where a field has several values for a key, the first or the last non-null one by
    ``position`` is kept. A key whose values are all NULL still yields a row. The field
    list is fixed, so no extra pass looks for it, and both aggregations combine before
    their shuffle; a key with very many rows is therefore no burden.
    """
    pick = {"first": F.min_by, "last": F.max_by}[keep]
    if since is not None:
        df = df.filter(F.col(key) >= F.lit(since).cast("date"))
    ranked = F.when(F.col(value).isNotNull(), F.col(position))
    return df.groupBy(key).pivot(series, fields).agg(pick(F.col(value), ranked))


def select_matrix(df: DataFrame, headings: list[str | None], fields: list[str],
                  date_column: str) -> DataFrame:
    """Matrix sheet to one row per dated input row.

    Rows that do not start with an eight-digit date are dropped. If several columns
    describe the same field, the rightmost value present wins.
    """
    by_field: dict[str, list[Column]] = {}
    for name, heading in zip(df.columns, headings):
        field = field_of_heading(heading, [(f, f) for f in fields])
        if field is not None:
            cell = clean.to_double(F.col(f"`{name}`"))
            by_field.setdefault(field, []).insert(0, cell)
    return (
        df.select(
            clean.yyyymmdd_to_date(F.col(f"`{date_column}`")).alias("date"),
            *[
                F.coalesce(*by_field[f]).alias(f) if f in by_field
                else F.lit(None).cast("double").alias(f)
                for f in fields
            ],
        )
        .filter(F.col("date").isNotNull())
    )
