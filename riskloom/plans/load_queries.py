"""Registered loads, reshaping, sinks and the panel stream."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from riskloom import schemas
from riskloom.functions import fixed_values as fv
from riskloom.functions.clean import iso_frame
from riskloom.operators import integrity, reshape
from riskloom.plans import bindings as b, loads, quarantine
from riskloom.plans.registry import query
from riskloom.session import scratch_path
from riskloom.sources import sheets, sinks
from riskloom.streaming import panel_stream as stream

PANEL_SQL = """
SELECT CAST(floor(company_number / 1000) AS INTEGER) AS u3_company_number, year, month,
       company_number, stk_index, dtd
FROM panel_text
"""
FIRST_SQL = f"""
SELECT * EXCLUDE (pick) FROM (
  SELECT *, row_number() OVER (PARTITION BY u3_company_number, year, month
    ORDER BY company_number, stk_index NULLS FIRST, dtd NULLS FIRST) AS pick FROM ({PANEL_SQL})
) WHERE pick = 1
"""


KNOWN_SQL = f"SELECT * FROM ({FIRST_SQL}) WHERE u3_company_number IN (SELECT u3_company_number FROM companies)"


@query("panel_load", KNOWN_SQL)
def panel_load(spark, sf):
    panel = loads.risk_panel(b.panel_text(spark, sf), b.companies(spark, sf))
    return panel.select(*loads.PANEL_KEY, "company_number", "stk_index", "dtd")


@query("panel_semi", f"""
SELECT u3_company_number, year, count(*) AS n_rows, count(dtd) AS n_present FROM ({PANEL_SQL})
WHERE u3_company_number IN (SELECT u3_company_number FROM companies) GROUP BY 1, 2
""")
def panel_semi(spark, sf):
    per_year = loads.panel_rows(b.panel_text(spark, sf)).groupBy("u3_company_number", "year").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("dtd").alias("n_present")
    )
    return integrity.keep_known(per_year, b.companies(spark, sf), "u3_company_number")


@query("panel_rejects", f"""
SELECT u3_company_number, count(*) AS n_rows FROM ({PANEL_SQL})
WHERE u3_company_number NOT IN (SELECT u3_company_number FROM companies) GROUP BY 1
""")
def panel_rejects(spark, sf):
    return loads.panel_rejects(b.panel_text(spark, sf), b.companies(spark, sf))


@query("panel_summary", f"""
WITH lines AS (
  SELECT company_number // 1000 AS company, year, month, company_number % 7 <> 0 AS dated,
         company_number // 1000 IN (SELECT u3_company_number FROM companies) AS known
  FROM panel_text
)
SELECT count(*) AS n_read,
       (SELECT count(*) FROM (SELECT DISTINCT company, year, month FROM lines WHERE dated AND known)) AS n_kept,
       count(*) FILTER (WHERE NOT dated) AS n_without_month,
       count(*) FILTER (WHERE dated AND NOT known) AS n_unknown_company,
       count(*) FILTER (WHERE dated AND known)
         - (SELECT count(*) FROM (SELECT DISTINCT company, year, month FROM lines WHERE dated AND known)) AS n_repeated,
       count(*) FILTER (WHERE month = 3) AS n_bad_numbers
FROM lines
""")
def panel_summary(spark, sf):
    """Lines are spoilt by a rule: no month where 7 divides the number, text in March."""
    raw = b.panel_text(spark, sf)
    spoilt = raw.withColumns({
        "sigma": F.when(F.col("month") == "3", F.lit("about 2")).otherwise(F.col("sigma")),
        "month": F.when(F.col("company_number").cast("long") % 7 != 0, F.col("month")),
    })
    return loads.panel_summary(spoilt, b.companies(spark, sf))


def _wins_sql(function: str) -> str:
    columns = ", ".join(
        f"{function}(value, position) FILTER (WHERE series = '{s}' AND value IS NOT NULL) AS \"{s}\""
        for s in b.SERIES
    )
    return f"SELECT CAST(date AS VARCHAR) AS date, {columns} FROM macro_long GROUP BY macro_long.date"


@query("first_nonnull_wins", _wins_sql("min_by"))
def first_nonnull_wins(spark, sf):
    return iso_frame(reshape.long_to_wide(b.macro_long(spark, sf), b.SERIES, keep="first"))


@query("last_nonnull_wins", _wins_sql("max_by"))
def last_nonnull_wins(spark, sf):
    return iso_frame(reshape.long_to_wide(b.macro_long(spark, sf), b.SERIES, keep="last"))


# Value headings of a paired sheet, by the series that fills them.
PAIRED = {
    "click": "CBOE VIX close",
    "error": "Nominal GDP, billions",
    "purchase": "S&P 500 level",
    "signup": "No such thing",
    "view": "CPI, all items",
}


def _paired_sheet(spark, sf):
    """Each event fills the (date, value) columns of its series and leaves the others blank.

    GDP is dated by quarter, and CPI forty years back, before the cutoff.
    """
    long = b.macro_long(spark, sf)
    columns, headings = [], []
    for series, heading in PAIRED.items():
        mine = F.col("series") == series
        day = F.col("date")
        if series == "error":
            text = F.concat(F.lit("Q"), F.quarter(day).cast("string"), F.lit(" "), F.year(day).cast("string"))
        elif series == "view":
            text = F.add_months(day, -480).cast("string")
        else:
            text = day.cast("string")
        columns.append(F.when(mine, text).alias(f"date_{series}"))
        columns.append(F.when(mine, F.coalesce(F.col("value").cast("string"), F.lit("NA"))).alias(f"value_{series}"))
        headings += ["Date", heading]
    return long.select(*columns, F.col("position").alias(sheets.ROW)), headings


US_MACRO_SQL = """
WITH kept AS (
  SELECT CASE series WHEN 'error' THEN last_day(make_date(year(date), quarter(date) * 3, 1)) ELSE date END AS day,
         series, value, position
  FROM macro_long WHERE series IN ('click', 'error', 'purchase')
)
SELECT CAST(day AS VARCHAR) AS date,
       max_by(value, position) FILTER (WHERE series = 'click' AND value IS NOT NULL) AS vix,
       max_by(value, position) FILTER (WHERE series = 'error' AND value IS NOT NULL) AS gdp,
       max_by(value, position) FILTER (WHERE series = 'purchase' AND value IS NOT NULL) AS sp500
FROM kept GROUP BY day
"""


@query("macro_long_to_wide", US_MACRO_SQL)
def macro_long_to_wide(spark, sf):
    sheet, headings = _paired_sheet(spark, sf)
    cells = reshape.unpair_sheet(sheet, headings, fv.US_MACRO_SERIES, sheets.ROW)
    wide = reshape.long_to_wide(cells, ["vix", "gdp", "sp500"], keep="last", since="1990-01-01")
    return iso_frame(wide)


def _write_us_macros(spark, sf, path):
    """The paired sheet as files; date headings differ, as a sheet's columns do here."""
    sheet, headings = _paired_sheet(spark, sf)
    names = [f"d{i}" if h == "Date" else h for i, h in enumerate(headings)]
    ordered = sheet.repartitionByRange(sheets.ROW).sortWithinPartitions(sheets.ROW)
    _write_sheet(ordered.drop(sheets.ROW).toDF(*names), path)


@query("macro_us_load", US_MACRO_SQL)
def macro_us_load(spark, sf):
    """As ``macro_long_to_wide``, from a sheet in files."""
    path = scratch_path(spark, "us-macros")
    _write_us_macros(spark, sf, path)
    wide = loads.us_macros(sheets.read_numbered_sheet(spark, path))
    return iso_frame(wide.select("date", "vix", "gdp", "sp500"))


FX_SQL = """
SELECT CAST(date AS VARCHAR) AS date, click AS audusd, coalesce(purchase, error) AS usdjpy, view AS eurusd
FROM macro_wide
"""
FX_HEADINGS = [None, "AUDUSD Curncy", "USDJPY fixing", "spot USDJPY", "Total", "EurUsd Curncy"]


def _fx_matrix(spark, sf):
    return b.macro_wide(spark, sf).select(
        F.date_format("date", "yyyyMMdd").alias("_c0"),
        *[F.coalesce(F.col(s).cast("string"), F.lit("N/A")).alias(f"_c{i + 1}") for i, s in enumerate(b.SERIES)],
    )


@query("fx_load", FX_SQL)
def fx_load(spark, sf):
    rates = reshape.select_matrix(_fx_matrix(spark, sf), FX_HEADINGS, fv.FX_PAIRS, "_c0")
    return iso_frame(rates.select("date", "audusd", "usdjpy", "eurusd"))


def _write_fx(spark, sf, path):
    """A title line, the line of descriptions, then the rates; every part opens so."""
    _write_lines(_fx_matrix(spark, sf), ["FX rates", ",".join(h or "" for h in FX_HEADINGS)], path)


@query("macro_fx_load", FX_SQL)
def macro_fx_load(spark, sf):
    """As ``fx_load``, from a matrix sheet in files."""
    path = scratch_path(spark, "fx-rates")
    _write_fx(spark, sf, path)
    rates = loads.fx_rates(*sheets.read_matrix(spark, path))
    return iso_frame(rates.select("date", "audusd", "usdjpy", "eurusd"))


def _write_sheet(df, path):
    df.write.options(header=True, escape='"').csv(path)


def _export_sheets(spark, sf) -> str:
    """The bundled tables as the sheets the loads expect."""
    source = scratch_path(spark, "sheets")
    _write_sheet(b.industry(spark, sf), f"{source}/{loads.SHEET_FILES['industry_mapping']}")
    _write_sheet(
        b.companies(spark, sf).withColumnRenamed("company_name", "Company Name"),
        f"{source}/{loads.SHEET_FILES['companies']}",
    )
    events = b.undated_events(spark, sf).drop("id", "event_type")
    _write_sheet(events, f"{source}/{loads.SHEET_FILES['credit_events']}")
    macro = b.macro_wide(spark, sf)
    _write_sheet(
        macro.select(F.col("date").alias("Date"), *[F.col(s).alias(HEADINGS[s]) for s in HEADINGS]),
        f"{source}/{loads.SHEET_FILES['macro_commodities']}",
    )
    _write_sheet(
        macro.select(
            F.col("date").alias("Data Date"),
            F.col("click").alias("US Generic Govt 10 Year Yield"),
            F.col("view").alias("US Generic Govt 2 Year Yield"),
        ),
        f"{source}/{loads.SHEET_FILES['macro_bond_yields']}",
    )
    _write_us_macros(spark, sf, f"{source}/{loads.SHEET_FILES['macro_us']}")
    _write_fx(spark, sf, f"{source}/{loads.SHEET_FILES['macro_fx']}")
    _write_panel(b.panel_text(spark, sf), f"{source}/{loads.SHEET_FILES['risk_indicators']}")
    return source


HEADINGS = {"click": "WTI Crude spot", "error": "Brent Crude spot", "purchase": "Gold", "signup": "Copper", "view": "Corn"}


def _write_panel(panel, path):
    """Write panel text with the original headings of its columns, duplicate included."""
    names = dict(zip(schemas.PANEL_FIELDS, fv.PANEL_HEADINGS))
    _write_lines(panel, [",".join(names[c] for c in panel.columns)], path)


def _write_lines(rows, opening: list[str], path):
    """Comma-separated rows in files that all start with the same lines."""

    def opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": opening})
        yield from frames

    rows.select(F.concat_ws(",", *rows.columns).alias("value")).mapInPandas(opened, "value string").write.text(path)


@query("load_stats", f"""
WITH us_days AS (
  SELECT DISTINCT CASE series WHEN 'error' THEN last_day(make_date(year(date), quarter(date) * 3, 1)) ELSE date END
  FROM macro_long WHERE series IN ('click', 'error', 'purchase')
)
SELECT 'industry_mapping' AS table_name, count(*) AS n_rows FROM industry
UNION ALL SELECT 'companies', count(*) FROM companies
UNION ALL SELECT 'credit_events', count(*) FROM credit_events
UNION ALL SELECT 'macro_commodities', count(*) FROM macro_wide
UNION ALL SELECT 'macro_bond_yields', count(*) FROM macro_wide
UNION ALL SELECT 'macro_us', count(*) FROM us_days
UNION ALL SELECT 'macro_fx', count(*) FROM macro_wide
UNION ALL SELECT 'risk_indicators', count(*) FROM (
  SELECT DISTINCT u3_company_number, year, month FROM ({PANEL_SQL})
  WHERE u3_company_number IN (SELECT u3_company_number FROM companies))
""")
def load_stats(spark, sf):
    return loads.load_all(spark, _export_sheets(spark, sf), scratch_path(spark, "tables"))


def _spoiled(column, when, text):
    return F.when(when, F.lit(text)).otherwise(F.col(column).cast("string")).alias(column)


def _faulty_company_sheets(spark, sf) -> str:
    """Companies, their mapping and events, spoiled by a rule on the rows' own numbers."""
    source = scratch_path(spark, "faulty-sheets")
    _write_sheet(b.industry(spark, sf), f"{source}/{loads.SHEET_FILES['industry_mapping']}")
    companies = b.companies(spark, sf)
    _write_sheet(
        companies.withColumn("industry_subgroup_num", _spoiled("industry_subgroup_num", F.col("u3_company_number") % 30 == 0, "many")),
        f"{source}/{loads.SHEET_FILES['companies']}",
    )
    events = b.undated_events(spark, sf).withColumns({
        "announcement_date": _spoiled("announcement_date", F.col("id") % 40 == 0, "soon"),
        "u3_company_number": F.col("u3_company_number") + F.when(F.col("id") % 50 == 0, 10_000_000).otherwise(0),
    })
    _write_sheet(events.drop("id", "event_type"), f"{source}/{loads.SHEET_FILES['credit_events']}")
    return source


def _faulty_sheets(spark, sf) -> str:
    """All sheets, spoiled likewise."""
    source = _faulty_company_sheets(spark, sf)
    macro, day = b.macro_wide(spark, sf), F.dayofmonth("date")
    click = _spoiled("click", day % 5 == 0, "x")
    _write_sheet(
        macro.select(_spoiled("date", day % 9 == 0, "bad").alias("Date"), click.alias(HEADINGS["click"]), F.col("view").alias(HEADINGS["view"])),
        f"{source}/{loads.SHEET_FILES['macro_commodities']}",
    )
    _write_sheet(
        macro.select(_spoiled("date", day % 7 == 0, "").alias("Data Date"), click.alias("US Generic Govt 10 Year Yield")),
        f"{source}/{loads.SHEET_FILES['macro_bond_yields']}",
    )
    _write_us_macros(spark, sf, f"{source}/{loads.SHEET_FILES['macro_us']}")
    matrix = _fx_matrix(spark, sf).withColumn("_c0", _spoiled("_c0", F.substring("_c0", 7, 2).cast("int") % 7 == 0, "holiday"))
    _write_lines(matrix, ["FX rates", ",".join(h or "" for h in FX_HEADINGS)], f"{source}/{loads.SHEET_FILES['macro_fx']}")
    panel = b.panel_text(spark, sf).withColumns({
        "year": _spoiled("year", F.col("company_number").cast("long") % 60 == 0, "x"),
        "dtd": _spoiled("dtd", F.col("company_number").cast("long") % 45 == 0, "bad"),
    })
    _write_panel(panel, f"{source}/{loads.SHEET_FILES['risk_indicators']}")
    return source


@query("load_rejects", """
WITH days AS (SELECT *, day(date) AS d FROM macro_wide),
lines AS (
  SELECT *, (company_number // 1000) AS company, company_number % 60 <> 0 AS dated,
         (company_number // 1000) IN (SELECT u3_company_number FROM companies) AS known
  FROM panel_text
), found AS (
  SELECT 'companies' AS table_name, 'not_a_whole_number' AS reason, count(*) AS n FROM companies WHERE u3_company_number % 30 = 0
  UNION ALL SELECT 'credit_events', 'not_a_date', count(*) FROM undated WHERE id % 40 = 0
  UNION ALL SELECT 'credit_events', 'unknown_company', count(*) FROM undated WHERE id % 50 = 0
  UNION ALL SELECT 'macro_commodities', 'no_date', count(*) FROM days WHERE d % 9 = 0
  UNION ALL SELECT 'macro_commodities', 'not_a_number', count(*) FROM days WHERE d % 9 <> 0 AND d % 5 = 0
  UNION ALL SELECT 'macro_bond_yields', 'no_date', count(*) FROM days WHERE d % 7 = 0
  UNION ALL SELECT 'macro_bond_yields', 'not_a_number', count(*) FROM days WHERE d % 7 <> 0 AND d % 5 = 0
  UNION ALL SELECT 'macro_fx', 'no_date', count(*) FROM days WHERE d % 7 = 0 AND coalesce(click, error, purchase, view) IS NOT NULL
  UNION ALL SELECT 'risk_indicators', 'no_month', count(*) FROM lines WHERE NOT dated
  UNION ALL SELECT 'risk_indicators', 'not_a_number', count(*) FROM lines WHERE company_number % 45 = 0
  UNION ALL SELECT 'risk_indicators', 'unknown_company', count(*) FROM lines WHERE dated AND NOT known
  UNION ALL SELECT 'risk_indicators', 'repeated_month', count(*) - count(DISTINCT (company, year, month)) FROM lines WHERE dated AND known
)
SELECT * FROM found WHERE n > 0
""")
def load_rejects(spark, sf):
    """Refused rows and cells of all eight sheets by reason."""
    source, target = _faulty_sheets(spark, sf), scratch_path(spark, "faulty-tables")
    loads.load_all(spark, source, target, only=["companies"])
    return quarantine.write_rejects(spark, source, f"{target}/rejects", f"{target}/companies")


@query("load_refresh", """
SELECT 'companies' AS table_name, count(*) AS n_rows FROM companies
UNION ALL SELECT 'credit_events', count(*) FROM undated WHERE id % 50 <> 0
UNION ALL SELECT 'industry_mapping', count(*) FROM industry
""")
def load_refresh(spark, sf):
    """Companies and the mapping of one refresh stay valid beside the events of the next."""
    root, first = scratch_path(spark, "versions"), ["industry_mapping", "companies"]
    source = _faulty_company_sheets(spark, sf)
    loads.refresh_all(spark, source, root, first)
    loads.refresh_all(spark, source, root, ["credit_events"])
    tables = loads.open_current(spark, root)
    return functools.reduce(DataFrame.unionByName, [
        t.groupBy().agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows")) for name, t in sorted(tables.items())
    ])


@query("src_csv_roundtrip", """
SELECT CAST(u3_company_number AS INTEGER) AS u3_company_number, company_name, ticker, market_status,
       industry_subgroup_num FROM companies
""")
def src_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "company-sheet")
    _write_sheet(b.companies(spark, sf).withColumnRenamed("company_name", "Company Name"), path)
    loaded = loads.companies(sheets.read_sheet(spark, path))
    return loaded.select("u3_company_number", "company_name", "ticker", "market_status", "industry_subgroup_num")


@query("panel_dup_header", f"""
SELECT u3_company_number, year, month, dtd AS dtd_median, stk_index AS dtd_median_i FROM ({PANEL_SQL})
""")
def panel_dup_header(spark, sf):
    path = scratch_path(spark, "panel-file")
    _write_panel(b.panel_text(spark, sf), path)
    rows = loads.panel_rows(sheets.read_panel_csv(spark, path))
    return rows.select(*loads.PANEL_KEY, "dtd_median", "dtd_median_i")


@query("panel_by_name", f"""
SELECT * EXCLUDE (stk_index, dtd), dtd, dtd AS dtd_median_i, stk_index AS dtd_median, stk_index FROM ({KNOWN_SQL})
""")
def panel_by_name(spark, sf):
    """The columns of the file stand in reverse; of the two equal headings, the first one
    in the file is still the first."""
    path = scratch_path(spark, "panel-reversed")
    panel = b.panel_text(spark, sf)
    _write_panel(panel.select(*reversed(panel.columns)), path)
    loaded = loads.risk_panel(sheets.read_panel_csv(spark, path), b.companies(spark, sf))
    return loaded.select(*loads.PANEL_KEY, "company_number", "stk_index", "dtd", "dtd_median", "dtd_median_i")


@query("write_roundtrip", """
SELECT CAST(year(announcement_date) AS INTEGER) AS year, count(*) AS n_events, min(id) AS first_id,
       (SELECT count(*) FROM credit_events) AS n_written
FROM credit_events GROUP BY 1
""")
def write_roundtrip(spark, sf):
    path = scratch_path(spark, "events-table")
    events = b.credit_events(spark, sf).withColumn("year", F.year("announcement_date"))
    written = sinks.write_table(events, path, partition_by=["year"], sort_by=["u3_company_number"])
    return spark.read.parquet(path).groupBy("year").agg(
        F.count(F.lit(1)).alias("n_events"), F.min("id").alias("first_id"), F.lit(written).cast("long").alias("n_written")
    )


@query("panel_stream", KNOWN_SQL)
def panel_stream(spark, sf):
    source, target = scratch_path(spark, "panel-files"), scratch_path(spark, "panel-table")
    _write_panel(b.panel_text(spark, sf).repartition(4, "company_number"), source)
    known = b.companies(spark, sf)
    job = stream.stream_panel(spark, source, known, target, scratch_path(spark, "panel-progress"), max_files=2)
    job.awaitTermination()
    return stream.stored_panel(spark, target).select(*loads.PANEL_KEY, "company_number", "stk_index", "dtd")
