import random

from pyspark.sql import functions as F

from riskloom.operators import integrity, ranking


def test_positions_in_hot_and_small_groups(spark):
    rng = random.Random(3)
    rows = [("hot", rng.randrange(4), i) for i in range(3000)] + [
        (f"g{rng.randrange(200)}", rng.randrange(50), i) for i in range(3000, 9000)
    ]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, day int, id long")
    got = ranking.number_rows(
        df, ["g"], {"_d": F.col("day"), "_s": F.floor(F.col("id") / 100.0)}, [F.col("id").asc()]
    )
    expected = {}
    for g in {r[0] for r in rows}:
        for position, row in enumerate(sorted(r for r in rows if r[0] == g)):
            expected[row] = position
    assert {(r["g"], r["day"], r["id"]): r["position"] for r in got.collect()} == expected


def test_hot_group_is_spread_over_slices(spark):
    df = spark.range(20000).select(F.lit("hot").alias("g"), (F.col("id") % 3).alias("day"), "id")
    got = ranking.number_rows(
        df, ["g"], {"_d": F.col("day"), "_s": F.floor(F.col("id") / 500.0)}, [F.col("id").asc()]
    )
    plan = got._jdf.queryExecution().executedPlan().toString()
    widest = [line for line in plan.splitlines() if "row_number()" in line and "Window" in line]
    assert widest and all("_d" in line and "_s" in line for line in widest)
    assert got.agg(F.countDistinct("position"), F.max("position")).first()[:] == (20000, 19999)


def test_surrogate_ids_are_dense(spark):
    df = spark.createDataFrame([(k,) for k in (5, -7, 10**12, 999_999, 1_000_000, 2)], "key long")
    got = ranking.surrogate_ids(df, "key")
    assert [tuple(r) for r in got.orderBy("id").select("id", "key").collect()] == list(
        enumerate(sorted([5, -7, 10**12, 999_999, 1_000_000, 2]), 1)
    )


def test_content_ids_do_not_depend_on_splits(spark):
    rows = [(i % 7 if i % 3 else None, "hot" if i % 2 else f"x{i}") for i in range(600)] + [(1, "hot")] * 400
    df = spark.createDataFrame(rows, "a int, `b c` string")
    one = sorted(map(repr, ranking.content_ids(df.coalesce(1)).collect()))
    assert one == sorted(map(repr, ranking.content_ids(df.repartition(7)).collect()))
    got = ranking.content_ids(df)
    assert sorted(r["id"] for r in got.collect()) == list(range(1, 1001))
    assert sorted(map(repr, got.drop("id").collect())) == sorted(map(repr, df.collect()))
    assert ranking.content_ids(df.limit(0)).count() == 0


def test_top_k_per_group_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), "id")
    top = ranking.top_k_per_group(df, ["g"], [F.col("id").desc()], 2)
    assert sorted((r["g"], r["id"], r["rank"]) for r in top.collect()) == [
        (0, 996, 2), (0, 998, 1), (1, 997, 2), (1, 999, 1),
    ]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_known_rejected_and_pending(spark):
    rows = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    parents = spark.createDataFrame([(1,), (1,), (3,)], "k int")
    assert [r[0] for r in integrity.keep_known(rows, parents, "k").collect()] == [1, 1]
    assert {(r["k"], r["n_rows"]) for r in integrity.reject_counts(rows, parents, "k").collect()} == {(2, 1), (None, 1)}
    done = spark.createDataFrame([(2,)], "item int")
    items = spark.createDataFrame([(3,), (1,), (2,)], "k int")
    assert [r[0] for r in integrity.pending(items, done, "k", "item", limit=1).collect()] == [1]
    assert sorted(r[0] for r in integrity.pending(items, done, "k", "item").collect()) == [1, 3]
