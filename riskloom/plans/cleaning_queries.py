"""Registered cleaning jobs. Dirty text is derived from the tables' own values."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import clean, fixed_values as fv
from riskloom.operators import ranking
from riskloom.plans import bindings as b
from riskloom.plans.registry import query


def _status():
    return F.col("o_orderstatus")


def _priority():
    return F.col("o_orderpriority")


@query("clean_blank", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN ' ' || o_orderpriority || ' ' END AS kept,
       CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS trimmed,
       CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS price
FROM orders
""")
def clean_blank(spark, sf):
    raw = b.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(_status() == "P", F.lit("")).when(_status() == "F", F.lit("   "))
        .otherwise(F.concat(F.lit(" "), _priority(), F.lit(" "))).alias("raw"),
        F.when(_priority() == "5-LOW", F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("price"),
    )
    kept = clean.clean_blank(F.col("raw"))
    return raw.select(
        "o_orderkey", kept.alias("kept"), F.trim(kept).alias("trimmed"),
        clean.clean_nan(F.col("price")).alias("price"),
    )


def _raw_measure(lower_token: str):
    kind = F.col("event_type")
    return (
        F.when(kind == "click", F.lit("NA"))
        .when(kind == "view", F.lit(lower_token))
        .when(kind == "error", F.lit(""))
        .when(kind == "signup", F.lit("2024-01-01 00:00:00"))
        .otherwise(F.col("value").cast("string"))
    )


@query("clean_na", """
SELECT event_id,
       CASE event_type WHEN 'signup' THEN '2024-01-01 00:00:00' WHEN 'purchase' THEN CAST(value AS VARCHAR)
       END AS kept,
       CASE event_type WHEN 'purchase' THEN value END AS number,
       event_type = 'signup' AS rejected
FROM events
""")
def clean_na(spark, sf):
    raw = _raw_measure(" n/a ")
    return b.table(spark, sf, "events").select(
        "event_id",
        clean.clean_na(raw).alias("kept"),
        clean.to_double(raw).alias("number"),
        clean.is_rejected_number(raw).alias("rejected"),
    )


@query("clean_na_case", """
SELECT event_id,
       CASE event_type WHEN 'signup' THEN '2024-01-01 00:00:00' WHEN 'purchase' THEN CAST(value AS VARCHAR)
            WHEN 'view' THEN 'na' END AS kept,
       CASE event_type WHEN 'purchase' THEN value END AS number,
       event_type IN ('signup', 'view') AS rejected
FROM events
""")
def clean_na_case(spark, sf):
    raw = _raw_measure("na")
    return b.table(spark, sf, "events").select(
        "event_id",
        clean.clean_na(raw, ignore_case=False).alias("kept"),
        clean.to_double(raw).alias("number"),
        clean.is_rejected_number(raw, ignore_case=False).alias("rejected"),
    )


@query("company_key", """
SELECT o_orderkey, CAST(floor(((o_custkey + 25) * 1000 + o_orderkey % 1000) / 1000) AS INTEGER) AS u3_company_number
FROM orders
""")
def company_key(spark, sf):
    number = (F.col("o_custkey") + b.PANEL_SHIFT) * 1000 + F.col("o_orderkey") % 1000
    return b.table(spark, sf, "orders").select(
        "o_orderkey", clean.company_key(number).alias("u3_company_number")
    )


@query("required_key", "SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS u3_company_number FROM orders")
def required_key(spark, sf):
    raw = F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))
    return b.table(spark, sf, "orders").select(
        "o_orderkey", clean.required_int(raw, "u3_company_number").alias("u3_company_number")
    )


@query("to_date_lenient", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
       WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN NULL
       ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day
FROM orders
""")
def to_date_lenient(spark, sf):
    at = F.col("o_orderdate")
    raw = (
        F.when(_priority() == "1-URGENT", F.date_format(at, "yyyy-MM-dd"))
        .when(_priority() == "2-HIGH", F.date_format(at, "M/d/yyyy"))
        .when(_priority() == "3-MEDIUM", F.date_format(at, "yyyyMMdd"))
        .when(_priority() == "4-NOT SPECIFIED", F.lit("not a date"))
        .when(_status() == "F", F.lit(""))
        .when(_status() == "O", F.date_format(at, "d-MMM-yyyy"))
        .otherwise(at.cast("string"))
    )
    days = b.table(spark, sf, "orders").select("o_orderkey", clean.to_date_lenient(raw).alias("day"))
    return clean.iso_frame(days)


@query("quarter_end", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN NULL
  ELSE strftime(last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)), '%Y-%m-%d') END AS day
FROM orders
""")
def quarter_end(spark, sf):
    year = F.year("o_orderdate").cast("string")
    good = F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"), F.lit(" "), year)
    raw = (
        F.when((_status() == "P") & (_priority() == "1-URGENT"), F.concat(F.lit("Q5 "), year))
        .when((_status() == "P") & (_priority() == "2-HIGH"), F.concat(F.lit("3Q "), year))
        .when(_status() == "F", F.concat(F.lit("  "), good, F.lit(" revised")))
        .otherwise(good)
    )
    days = b.table(spark, sf, "orders").select("o_orderkey", clean.quarter_end(raw).alias("day"))
    return clean.iso_frame(days)


@query("yyyymmdd", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')
""")
def yyyymmdd(spark, sf):
    digits = F.date_format("o_orderdate", "yyyyMMdd")
    raw = (
        F.when(_priority() == "1-URGENT", F.substring(digits, 1, 7))
        .when(_priority() == "2-HIGH", F.concat(F.substring(digits, 1, 4), F.lit("1345")))
        .when(_priority() == "3-MEDIUM", F.concat(digits, F.lit(".0")))
        .otherwise(digits)
    )
    days = b.table(spark, sf, "orders").select("o_orderkey", clean.yyyymmdd_to_date(raw).alias("day"))
    return clean.iso_frame(days.filter(F.col("day").isNotNull()))


@query("iso_format", """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS day,
       CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
            ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts,
       strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') AS second
FROM events
""")
def iso_format(spark, sf):
    return clean.iso_frame(b.table(spark, sf, "events").select(
        "event_id", F.to_date("ts").alias("day"), "ts",
        F.date_trunc("second", "ts").cast("timestamp_ntz").alias("second"),
    ))


@query("decode_codes", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Bankruptcy Filing' WHEN 'O' THEN 'Delisting' END AS event_name
FROM orders
""")
def decode_codes(spark, sf):
    code = F.when(_status() == "F", F.lit(110)).when(_status() == "O", F.lit(208)).otherwise(F.lit(999))
    return b.table(spark, sf, "orders").select(
        "o_orderkey", clean.decode(code, fv.EVENT_TYPE_NAMES).alias("event_name")
    )


@query("normalize_headers", """
SELECT o_orderkey AS order_id, o_custkey AS u3_company_number, o_totalprice AS total_price_usd FROM orders
""")
def normalize_headers(spark, sf):
    return clean.normalize_headers(b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("Order ID"),
        F.col("o_custkey").alias("U3 Company Number"),
        F.col("o_totalprice").alias("Total Price USD"),
    ))


HEADINGS = {
    "click": "Generic 1st WTI CRUDE future",
    "view": "Spread of Silver against GOLD",
    "error": "kansas financial stress index, weekly",
    "signup": "Unrelated heading",
    "purchase": "ICE Gasoil",
}
_HEADING_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in HEADINGS.items()) + " END"
_FIELD_SQL = "CASE " + " ".join(
    f"WHEN contains(lower(heading), '{p.lower()}') THEN '{f}'" for p, f in fv.COMMODITY_SERIES
) + " END"


@query("match_series", f"""
SELECT event_id, heading, {_FIELD_SQL} AS field
FROM (SELECT event_id, {_HEADING_SQL} AS heading FROM events)
""")
def match_series(spark, sf):
    headed = b.table(spark, sf, "events").select(
        "event_id", clean.decode(F.col("event_type"), HEADINGS).alias("heading")
    )
    return headed.withColumn("field", clean.match_series(F.col("heading"), fv.COMMODITY_SERIES))


@query("surrogate_id", """
SELECT row_number() OVER (ORDER BY u3_company_number) AS id, u3_company_number, company_name FROM companies
""")
def surrogate_id(spark, sf):
    named = b.companies(spark, sf).select("u3_company_number", "company_name")
    return ranking.surrogate_ids(named, "u3_company_number")
