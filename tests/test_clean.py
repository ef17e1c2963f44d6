import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from riskloom.functions import clean, fixed_values as fv


def apply(spark, values, expr, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_blank_text_becomes_null_and_other_text_stays(spark):
    assert apply(spark, [None, "", "  ", " a ", "NA"], clean.clean_blank) == [None, None, None, " a ", "NA"]


def test_na_tokens(spark):
    values = [None, "", "  ", "NA", "na", "N/A", " n/a ", "hello", "123.45"]
    assert apply(spark, values, clean.clean_na) == [None] * 7 + ["hello", "123.45"]
    cased = apply(spark, values, lambda c: clean.clean_na(c, ignore_case=False))
    assert cased == [None, None, None, None, "na", None, " n/a ", "hello", "123.45"]


def test_nan_is_never_kept(spark):
    assert apply(spark, [float("nan"), 1.5, None], clean.clean_nan, "double") == [None, 1.5, None]
    assert apply(spark, ["NaN", "1.5", "x", "2008-09-15 00:00:00", " 7 "], clean.to_double) == [
        None, 1.5, None, None, 7.0,
    ]
    assert apply(spark, ["x", "NA", "", "3"], clean.is_rejected_number) == [True, False, False, False]


def test_frame_wide_na(spark):
    df = spark.createDataFrame([(1, "NA", "x"), (2, "", "na")], "i int, a string, b string")
    assert [tuple(r) for r in clean.clean_na_frame(df).orderBy("i").collect()] == [(1, None, "x"), (2, None, None)]


def test_integers_from_sheets(spark):
    assert apply(spark, ["10", "10.0", " 7 ", "1.5", "x", "", None], clean.to_int) == [10, 10, 7, None, None, None, None]
    assert apply(spark, ["10.0"], lambda c: clean.required_int(c, "key")) == [10]
    for bad in (None, "x", "1.5"):
        with pytest.raises(Exception, match="key: integer required"):
            apply(spark, [bad], lambda c: clean.required_int(c, "key"))


def test_company_key(spark):
    numbers = [31415926, 2718281, 7000, 42, 9000001, -1]
    assert apply(spark, numbers, clean.company_key, "long") == [31415, 2718, 7, 0, 9000, -1]


def test_dates(spark):
    values = ["2008-09-15", "2008-09-15 10:30:00", "9/15/2008", "20080915", "15-Sep-2008", "Sep 15, 2008",
              "2008-09-15 nonsense", "2008-13-45", "soon", "", None]
    day = dt.date(2008, 9, 15)
    assert apply(spark, values, clean.to_date_lenient) == [day] * 6 + [None] * 5


def test_quarters(spark):
    values = ["Q3 2008", " Q1  1999 revised", "Q2 2000", "Q4 2000", "Q5 2008", "Q0 2008", "3Q 2008", "Q1 20", None]
    assert apply(spark, values, clean.quarter_end) == [
        dt.date(2008, 9, 30), dt.date(1999, 3, 31), dt.date(2000, 6, 30), dt.date(2000, 12, 31),
        None, None, None, None, None,
    ]
    assert apply(spark, ["Q3 2008", "2008-01-02", "Qx"], clean.period_date) == [
        dt.date(2008, 9, 30), dt.date(2008, 1, 2), None,
    ]


def test_eight_digit_dates(spark):
    values = ["20080915", "20080915.0", "2008091", "20081345", "x", None]
    assert apply(spark, values, clean.yyyymmdd_to_date) == [dt.date(2008, 9, 15)] * 2 + [None] * 4
    assert apply(spark, [20080915, 7], clean.yyyymmdd_to_date, "long") == [dt.date(2008, 9, 15), None]


def test_series_matching_takes_the_first_pattern(spark):
    names = ["Generic WTI CRUDE", "Silver against gold", "ICE Gasoil", "Unleaded Gasoline", "other", None]
    assert apply(spark, names, lambda c: clean.match_series(c, fv.COMMODITY_SERIES)) == [
        "wti_crude", "gold", "gasoil", "gasoline", None, None,
    ]


def test_iso_text(spark):
    df = spark.sql(
        "SELECT DATE'2008-09-15' AS d, TIMESTAMP_NTZ'2008-09-15 01:02:03' AS a, "
        "TIMESTAMP_NTZ'2008-09-15 01:02:03.5' AS b, TIMESTAMP'2008-09-15 01:02:03.000001' AS c, 1 AS n"
    )
    assert tuple(clean.iso_frame(df).first()) == (
        "2008-09-15", "2008-09-15T01:02:03", "2008-09-15T01:02:03.500000", "2008-09-15T01:02:03.000001", 1,
    )
    assert isinstance(clean.iso_frame(df).schema["d"].dataType, T.StringType)


def test_headers_and_labels(spark):
    df = spark.createDataFrame([(1, 2)], "`U3 Company Number` int, `TICKER` int")
    assert clean.normalize_headers(df).columns == ["u3_company_number", "ticker"]
    assert apply(spark, ["", None, "Energy"], clean.label_or_na) == ["N/A", "N/A", "Energy"]
    assert apply(spark, [110, 301, 5, None], lambda c: clean.decode(c, fv.EVENT_TYPE_NAMES), "int") == [
        "Bankruptcy Filing", "Default Corp Action", None, None,
    ]
