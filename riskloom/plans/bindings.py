"""The bundled test tables seen as credit-research tables.

Customers play companies, nations and regions the industry mapping, orders the credit
events and (the largest order of a month) the risk panel, events the macro series.
Every function reads a whole table and selects what it needs; nothing is filtered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.functions import fixed_values as fv

SERIES = ["click", "error", "purchase", "signup", "view"]
# Company keys of the panel file start this much later, so that some are unknown.
PANEL_SHIFT = 25


# Declared, so that no job has to read file footers before a query is planned.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("u3_company_number"),
        F.col("c_name").alias("company_name"),
        F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("ticker"),
        F.col("c_mktsegment").alias("market_status"),
        F.col("c_nationkey").alias("industry_subgroup_num"),
    )


def industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("industry_subgroup_num"),
        F.col("n_name").alias("industry_subgroup"),
        F.col("n_regionkey").alias("industry_sector_num"),
        F.col("r_name").alias("industry_sector"),
    )


def companies_in_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies with the sector number that the real company sheet carries."""
    sectors = industry(spark, sf_dir).select("industry_subgroup_num", "industry_sector_num")
    return companies(spark, sf_dir).join(sectors, "industry_subgroup_num")


def companies_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies with the names of sector and industry; misses stay."""
    names = industry(spark, sf_dir).select(
        "industry_subgroup_num",
        F.col("industry_sector").alias("sector"),
        F.col("industry_subgroup").alias("industry"),
    )
    return companies(spark, sf_dir).join(names, "industry_subgroup_num", "left")


def credit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events. Undated and blank cases are made from the order's own values."""
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("u3_company_number"),
        day.alias("announcement_date"),
        F.date_add(day, 30).alias("effective_date"),
        F.col("o_orderstatus").alias("event_type"),
        F.col("o_orderpriority").alias("action_name"),
        F.when(F.col("o_orderstatus") == "P", F.lit(""))
        .when(F.col("o_orderstatus") == "F", F.concat(F.lit("Total: "), F.col("o_totalprice").cast("string")))
        .alias("subcategory"),
    )


def undated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``credit_events``, with no date where the status is ``P``."""
    e = credit_events(spark, sf_dir)
    return e.withColumn("announcement_date", F.when(F.col("event_type") != "P", F.col("announcement_date")))


def risk_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest order of each company month as its distance to default."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(
        F.col("o_custkey").alias("u3_company_number"),
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
    ).agg(F.max("o_totalprice").alias("dtd"))


def panel_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of the raw panel file: all text, with NA spellings by priority."""
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("string")
    priority = F.col("o_orderpriority")
    mixed = (
        F.when(priority == "1-URGENT", F.lit("NA"))
        .when(priority == "2-HIGH", F.lit("n/a"))
        .when(priority == "3-MEDIUM", F.lit(""))
        .otherwise(price)
    )
    texts = {m: F.lit("N/A") for m in fv.PANEL_MEASURES} | {
        "stk_index": price, "dtd_median": mixed, "dtd_median_i": price, "dtd": mixed,
    }
    number = (F.col("o_custkey") + PANEL_SHIFT) * 1000 + F.col("o_orderkey") % 1000
    return o.select(
        number.cast("string").alias("company_number"),
        F.concat(F.year("o_orderdate").cast("string"), F.lit(".0")).alias("year"),
        F.month("o_orderdate").cast("string").alias("month"),
        *[texts[m].alias(m) for m in fv.PANEL_MEASURES],
    )


def macro_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as (date, series, value, position); NULL where a value's cents end in 0."""
    e = table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("long")
    return e.select(
        F.to_date("ts").alias("date"),
        F.col("event_type").alias("series"),
        F.when(cents % 10 != 0, F.col("value")).alias("value"),
        F.col("event_id").alias("position"),
    )


def macro_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest value per day and series, one column per series."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.to_date("ts").alias("date")).pivot("event_type", SERIES).agg(F.max("value"))
