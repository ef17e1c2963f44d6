import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.functions import fixed_values as fv
from riskloom.operators import reshape
from riskloom.plans import loads
from riskloom.sources import sheets


def long(spark, rows):
    return spark.createDataFrame(rows, "date string, series string, value double, position long").withColumn(
        "date", F.col("date").cast("date")
    )


ROWS = [
    ("2008-09-15", "a", None, 1), ("2008-09-15", "a", 5.0, 2), ("2008-09-15", "a", 7.0, 3),
    ("2008-09-15", "a", None, 4), ("2008-09-15", "b", 1.0, 5), ("2008-09-16", "b", None, 6),
    ("1989-12-31", "a", 9.0, 7),
]


@pytest.mark.parametrize("keep, a", [("first", 5.0), ("last", 7.0)])
def test_first_and_last_present_value_win(spark, keep, a):
    wide = reshape.long_to_wide(long(spark, ROWS), ["a", "b"], keep=keep, since="1990-01-01")
    got = {str(r["date"]): (r["a"], r["b"]) for r in wide.collect()}
    assert got == {"2008-09-15": (a, 1.0), "2008-09-16": (None, None)}


def test_hot_date_is_combined_before_the_shuffle(spark):
    hot = spark.range(30000).select(
        F.lit("2008-09-15").cast("date").alias("date"), F.lit("a").alias("series"),
        F.col("id").cast("double").alias("value"), F.col("id").alias("position"),
    )
    wide = reshape.long_to_wide(hot.unionByName(long(spark, ROWS)), ["a"], keep="last")
    assert wide.filter("date = '2008-09-15'").first()["a"] == 29999.0
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan


def test_pair_sheet(spark):
    columns = "d0 string, v0 string, note string, d1 string, v1 string, _row long"
    sheet = spark.createDataFrame([
        ("2008-09-15", "31.7", "x", "Q3 2008", "14.5", 1),
        ("1989-05-01", "12.0", "x", "Q9 2008", "99", 2),
        ("2008-09-15", "32.0", "x", "Q3 2008", "NA", 3),
        (None, "1.0", "x", "2008-10-01", "na", 4),
    ], columns)
    headings = ["Date", "CBOE VIX Index", "comment", "Date", "Real GDP"]
    cells = reshape.unpair_sheet(sheet, headings, fv.US_MACRO_SERIES, "_row")
    wide = reshape.long_to_wide(cells, ["vix", "gdp"], keep="last", since="1990-01-01")
    got = {str(r["date"]): (r["vix"], r["gdp"]) for r in wide.collect()}
    # "na" is no NA token here; it is simply not a number.
    assert got == {"2008-09-15": (32.0, None), "2008-09-30": (None, 14.5), "2008-10-01": (None, None)}


def test_column_order_beats_row_order(spark):
    sheet = spark.createDataFrame(
        [("2008-09-15", None, "3", 1), ("2008-09-15", "2", "4", 2)], "Date string, g1 string, g2 string, _row long"
    )
    cells = reshape.unpivot_sheet(
        sheet, F.col("Date").cast("date"), [None, "Gold spot", "Gold future"], fv.COMMODITY_SERIES, "_row"
    )
    assert reshape.long_to_wide(cells, ["gold"], keep="first").first()["gold"] == 2.0
    assert reshape.long_to_wide(cells, ["gold"], keep="last").first()["gold"] == 4.0


def test_no_known_heading(spark):
    sheet = spark.createDataFrame([("a", 1)], "x string, _row long")
    with pytest.raises(ValueError):
        reshape.unpivot_sheet(sheet, F.current_date(), ["nothing"], fv.COMMODITY_SERIES, "_row")


@pytest.mark.parametrize("title", ["FX rates,,,", "FX rates"])
def test_matrix_file(spark, tmp_path, title):
    path = tmp_path / "fx.csv"
    path.write_text(
        title + "\n,AUDUSD Curncy,USDJPY Curncy,JPY again: usdjpy\n"
        "20080915,0.81,105.1,\n20080916.0,NA,104.0,104.5\n2008091,1,1,1\ntotal,1,1,1\n"
    )
    fx = loads.fx_rates(*sheets.read_matrix(spark, str(path)))
    assert fx.columns == ["date", *fv.FX_PAIRS]
    got = {r["date"]: (r["audusd"], r["usdjpy"], r["eurusd"]) for r in fx.collect()}
    assert got == {dt.date(2008, 9, 15): (0.81, 105.1, None), dt.date(2008, 9, 16): (None, 104.5, None)}
