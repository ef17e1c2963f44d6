"""What the loads of the sheets refuse: rows and cells with the reason, and their counts."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from riskloom.functions import clean, fixed_values as fv
from riskloom.operators import integrity, reshape
from riskloom.plans import loads
from riskloom.sources import sheets

NO_DATE, NO_MONTH = "no_date", "no_month"
NOT_A_DATE, NOT_A_NUMBER, NOT_WHOLE = "not_a_date", "not_a_number", "not_a_whole_number"
UNKNOWN_COMPANY, REPEATED = "unknown_company", "repeated_month"
REASONS = [NO_DATE, NO_MONTH, NOT_A_DATE, NOT_A_NUMBER, NOT_WHOLE, UNKNOWN_COMPANY, REPEATED]
SCHEMA = "table_name string, reason string, column_name string, value string, line string"


def _present(cell: Column) -> Column:
    return clean.clean_na(clean.clean_blank(cell), True).isNotNull()


class _Checks:
    """Conditions on the cells of a sheet; each true one gives a row."""

    def __init__(self, raw: DataFrame, table: str):
        self.raw, self.table, self.found = raw, table, []

    def reject(self, reason: str, name: str, cell: Column, when: Column) -> None:
        self.found.append(F.when(when, F.struct(F.lit(reason).alias("reason"), F.lit(name).alias("column_name"), cell.cast("string").alias("value"))))

    def whole(self, *names: str) -> _Checks:
        for n in names:
            if n in self.raw.columns:
                self.reject(NOT_WHOLE, n, F.col(n), _present(F.col(n)) & clean.to_int(F.col(n)).isNull())
        return self

    def dates(self, *names: str) -> _Checks:
        for n in names:
            if n in self.raw.columns:
                self.reject(NOT_A_DATE, n, F.col(n), _present(F.col(n)) & clean.to_date_lenient(F.col(n)).isNull())
        return self

    def numbers(self, names: Iterable[str], where: Column) -> _Checks:
        for n in names:
            self.reject(NOT_A_NUMBER, n, F.col(f"`{n}`"), where & F.coalesce(clean.is_rejected_number(F.col(f"`{n}`")), F.lit(False)))
        return self

    def rows(self) -> DataFrame:
        columns = [F.col(f"`{c}`") for c in self.raw.columns if c != sheets.ROW]
        cells = F.filter(F.array(*self.found), lambda x: x.isNotNull())
        return self.raw.select(F.explode(cells).alias("r"), F.to_json(F.struct(*columns)).alias("line")).select(
            F.lit(self.table).alias("table_name"), "r.reason", "r.column_name", "r.value", "line"
        )


def _unknown(raw: DataFrame, key: Column, known: DataFrame, table: str, name: str) -> DataFrame:
    """Rows of companies that are not known."""
    columns = [F.col(c) for c in raw.columns]
    keyed = raw.select(key.alias("u3_company_number"), F.col(name).alias("value"), F.to_json(F.struct(*columns)).alias("line"))
    return integrity.rejects(keyed, known, "u3_company_number").select(
        F.lit(table).alias("table_name"), F.lit(UNKNOWN_COMPANY).alias("reason"), F.lit(name).alias("column_name"), F.col("value").cast("string").alias("value"), "line"
    )


def credit_events(raw: DataFrame, known: DataFrame) -> DataFrame:
    cells = _Checks(raw, "credit_events").whole("id_bb_company", "event_type").dates("announcement_date", "effective_date").rows()
    return cells.unionByName(_unknown(raw, clean.to_int(F.col("u3_company_number")), known, "credit_events", "u3_company_number"))


def commodities(sheet: DataFrame) -> DataFrame:
    names = [c for c in sheet.columns if c != sheets.ROW]
    date = clean.to_date_lenient(F.col(f"`{names[0]}`"))
    checks = _Checks(sheet, "macro_commodities")
    checks.reject(NO_DATE, names[0], F.col(f"`{names[0]}`"), date.isNull())
    known = [n for n in names[1:] if reshape.field_of_heading(n, fv.COMMODITY_SERIES)]
    return checks.numbers(known, date.isNotNull()).rows()


def bond_yields(raw: DataFrame) -> DataFrame:
    date = clean.to_date_lenient(F.col("data_date"))
    checks = _Checks(raw, "macro_bond_yields")
    checks.reject(NO_DATE, "data_date", F.col("data_date"), date.isNull())
    return checks.numbers([h for h in fv.YIELD_COLUMNS if h in raw.columns], date.isNotNull()).rows()


def us_macros(sheet: DataFrame) -> DataFrame:
    """Each series has dates of its own; a pair without date counts where it has a value."""
    names = [c for c in sheet.columns if c != sheets.ROW]
    checks = _Checks(sheet, "macro_us")
    for date, value, _ in reshape.paired_columns(names, fv.US_MACRO_SERIES):
        dated = clean.period_date(F.col(f"`{names[date]}`")).isNotNull()
        checks.reject(NO_DATE, names[value], F.col(f"`{names[date]}`"), ~dated & _present(F.col(f"`{names[value]}`")))
        checks.numbers([names[value]], dated)
    return checks.rows()


def fx_rates(matrix: DataFrame, headings: list[str | None]) -> DataFrame:
    """Rows with a rate but no date; title and heading rows have no rates."""
    known = [c for c, h in zip(matrix.columns, headings) if reshape.field_of_heading(h, [(f, f) for f in fv.FX_PAIRS])]
    first = matrix.columns[0]
    dated = clean.yyyymmdd_to_date(F.col(first)).isNotNull()
    rates = reduce(lambda a, b: a | b, [clean.to_double(F.col(c)).isNotNull() for c in known], F.lit(False))
    checks = _Checks(matrix, "macro_fx")
    checks.reject(NO_DATE, first, F.col(first), ~dated & rates)
    return checks.numbers(known, dated).rows()


def risk_panel(raw: DataFrame, known: DataFrame) -> DataFrame:
    """Lines without month, of unknown companies and beyond the first of a company month;
    bad numbers of any line. Lines of one company month are counted, not listed, before
    the first is set aside, so a hot month is one row."""
    year, month = clean.to_int(F.col("year")), clean.to_int(F.col("month"))
    dated = year.isNotNull() & month.isNotNull()
    checks = _Checks(raw, "risk_indicators")
    checks.reject(NO_MONTH, "month", F.concat_ws("-", F.col("year"), F.col("month")), ~dated)
    cells = checks.numbers(fv.PANEL_MEASURES, F.lit(True)).rows()
    key = clean.company_key(clean.to_double(F.col("company_number")))
    unknown = _unknown(raw.filter(dated), key, known, "risk_indicators", "company_number")
    lines = raw.filter(dated).groupBy(key.alias("u3_company_number"), year.alias("year"), month.alias("month")).agg(F.count(F.lit(1)).alias("n"))
    repeated = integrity.keep_known(lines.filter("n > 1"), known, "u3_company_number").select(
        F.lit("risk_indicators").alias("table_name"), F.lit(REPEATED).alias("reason"), F.lit("company_number").alias("column_name"),
        (F.col("n") - 1).cast("string").alias("value"), F.to_json(F.struct("u3_company_number", "year", "month", "n")).alias("line"),
    )
    return cells.unionByName(unknown).unionByName(repeated)


def rejects(spark: SparkSession, table: str, path: str, companies_path: str) -> DataFrame:
    """What the load of one sheet refuses: table, reason, column, text of the cell, line."""
    if table == "industry_mapping":
        return _Checks(sheets.read_sheet(spark, path), table).whole("industry_sector_num", "industry_group_num", "industry_subgroup_num").rows()
    if table == "companies":
        return _Checks(sheets.read_sheet(spark, path), table).whole(
            "id_bb_company", "industry_sector_num", "industry_group_num", "industry_subgroup_num"
        ).rows()
    if table == "macro_commodities":
        return commodities(sheets.read_numbered_sheet(spark, path))
    if table == "macro_bond_yields":
        return bond_yields(sheets.read_sheet(spark, path))
    if table == "macro_us":
        return us_macros(sheets.read_numbered_sheet(spark, path))
    if table == "macro_fx":
        return fx_rates(*sheets.read_matrix(spark, path))
    known = spark.read.parquet(companies_path)
    if table == "credit_events":
        return credit_events(sheets.read_sheet(spark, path), known)
    return risk_panel(sheets.read_panel_csv(spark, path), known)


def write_rejects(spark: SparkSession, source: str, target: str, companies_path: str, only: Iterable[str] | None = None) -> DataFrame:
    """Write all refused rows and cells below ``target``, by table; gives their counts.

    ``(table_name, reason, n)`` for every reason that occurred, observed during the write.
    A repeated month counts its lines beyond the first, as its ``value`` says.
    """
    tables = loads._wanted(only)
    found = reduce(DataFrame.unionByName, [rejects(spark, t, f"{source}/{loads.SHEET_FILES[t]}", companies_path) for t in tables])
    seen = Observation(f"rejects-{uuid.uuid4().hex}")
    weight = F.when(F.col("reason") == REPEATED, F.col("value").cast("long")).otherwise(F.lit(1).cast("long"))
    kinds = [(t, r) for t in tables for r in REASONS]
    counts = [F.sum(F.when((F.col("table_name") == t) & (F.col("reason") == r), weight)).alias(f"{t}:{r}") for t, r in kinds]
    found.observe(seen, *counts).write.mode("overwrite").partitionBy("table_name").parquet(target)
    rows = [(t, r, seen.get[f"{t}:{r}"]) for t, r in kinds if seen.get[f"{t}:{r}"]]
    return spark.createDataFrame(rows, "table_name string, reason string, n long")
