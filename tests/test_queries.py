"""Every registered query against its SQL, and the shape of its plan."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check_oracle
from riskloom.operators import context
from riskloom.plans import bindings as b, catalog, reports

WITHOUT_SQL = {"ann_recall"}


@pytest.fixture(scope="module")
def con(data):
    return check_oracle.connect(data)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, data, name):
    problem, n = check_oracle.compare(spark, con, name, data)
    assert problem == "" and n > 0


def test_which_queries_have_sql():
    assert set(catalog.QUERIES) - set(catalog.SQL) == WITHOUT_SQL
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["u3_company_number", "n_events", "company_name", "ticker"]


CHEAP = sorted(set(entry.queries()) - {"load_stats", "panel_stream", "ann_topk", "write_roundtrip"})


@pytest.mark.parametrize("name", CHEAP)
def test_no_query_pairs_all_rows(spark, data, name):
    plan = plan_of(entry.queries()[name](spark, data))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = plan_of(entry.queries()["top_defaults"](spark, data))
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_orderpriority:string>" in plan
    assert "TakeOrderedAndProject" in plan and "partial_count" in plan


def test_key_filter_reaches_both_sides(spark, data):
    plan = plan_of(entry.queries()["company_events"](spark, data))
    assert "EqualTo(o_custkey,7)" in plan and "EqualTo(c_custkey,7)" in plan


def test_hot_company_gives_the_same_rows(spark, data):
    """A third of all events belong to one company; pages and counts stay exact."""
    events = b.credit_events(spark, data)
    hot = events.withColumn(
        "u3_company_number", F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("u3_company_number"))
    )
    total = hot.count()
    pages = reports.nested_events(hot, page_size=7)
    sizes = pages.groupBy("u3_company_number").agg(
        F.sum("n_events").alias("n"), F.max("n_events").alias("most"), F.count("*").alias("pages")
    )
    assert sizes.agg(F.sum("n"), F.max("most")).first()[:] == (total, 7)
    assert sizes.filter("pages <> ceil(n / 7)").count() == 0
    one = sizes.filter("u3_company_number = 1").first()
    assert one["n"] > total / 3
    profile = context.company_profile(b.companies_described(spark, data), hot, page_size=7)
    assert profile.agg(F.sum("n_events")).first()[0] == total
    top = reports.top_companies(b.companies(spark, data), hot, "1-URGENT", 1).first()
    assert top["u3_company_number"] == 1


def test_joins_on_a_hot_company_are_split(spark):
    """Joins that cannot be aggregated first keep the large side where Spark can split it."""
    data = "/root/testdata/sf0.01"
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        events = b.credit_events(spark, data).withColumn(
            "u3_company_number", F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("u3_company_number"))
        ).repartition(8)
        companies = b.companies_described(spark, data)
        jobs = {
            "recent": reports.recent_events(companies, events, "1-URGENT", 10_000),
            "profile": context.company_profile(companies, events, page_size=2),
        }
        for name, df in jobs.items():
            assert df.collect(), name
            assert "skew=true" in plan_of(df), name
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
