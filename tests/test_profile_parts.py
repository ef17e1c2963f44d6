import pytest
from pyspark.sql import functions as F

from riskloom.operators import profile, profile_parts


@pytest.fixture
def events(spark):
    return spark.range(6000).select(
        F.col("id"), (F.col("id") % 7).cast("int").alias("month"), F.concat(F.lit("name "), F.col("id") % 1500).alias("name"),
        F.when(F.col("id") % 3 > 0, F.col("id") / 10).alias("value"), F.lit(None).cast("date").alias("never"),
    )


def exact_part(df):
    return sorted(tuple(v for k, v in r.asDict().items() if k != "n_distinct") for r in df.collect())


def test_new_month_is_read_alone_and_equals_the_whole(spark, events, tmp_path):
    target = str(tmp_path / "states")
    profile_parts.store_parts(events.where("month < 6"), "month", target)
    profile_parts.store_parts(events.where("month = 6"), "month", target)
    whole = profile.table_profile({"events": events}, {"events": ["id"]}, exact=True)
    united = profile_parts.united_profile(spark, target, "events", events.schema, ["id"])
    assert united.columns == whole.columns and exact_part(united) == exact_part(whole)
    want = {r.column_name: r.n_distinct for r in whole.collect()}
    for r in united.collect():
        assert abs(r.n_distinct - want[r.column_name]) <= 4 * profile_parts.STANDARD_ERROR * want[r.column_name]


def test_part_given_again_is_replaced(spark, events, tmp_path):
    target = str(tmp_path / "states")
    profile_parts.store_parts(events, "month", target)
    profile_parts.store_parts(events.where("month = 2 AND id < 100"), "month", target)
    left = events.where("month <> 2 OR id < 100")
    united = profile_parts.united_profile(spark, target, "e", events.schema)
    assert exact_part(united) == exact_part(profile.table_profile({"e": left}, exact=True))


def test_null_part_and_no_rows(spark, events, tmp_path):
    odd = events.withColumn("month", F.when(F.col("month") > 0, F.col("month")))
    profile_parts.store_parts(odd, "month", str(tmp_path / "a"))
    assert profile_parts.united_profile(spark, str(tmp_path / "a"), "e", odd.schema).first().n_rows == 6000
    states = profile_parts.part_states(events.limit(0), "month")
    states.write.parquet(str(tmp_path / "b"))
    rows = profile_parts.united_profile(spark, str(tmp_path / "b"), "e", events.schema).collect()
    assert [(r.n_rows, r.n_present, r.n_distinct, r.min_value) for r in rows] == [(0, 0, 0, None)] * 5
