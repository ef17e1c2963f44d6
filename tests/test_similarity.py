import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.functions import vector
from riskloom.operators import ann, similarity


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 8))
    base[100:200] = base[100]  # a third of all rows are copies of one vector
    base[200:210] = base[200:210].round(0)
    base[250] = 0
    return base


@pytest.fixture(scope="module")
def items(spark, vectors):
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(vectors)]
    rows += [(900, None, 0), (901, [1.0], 0), (902, [float("nan")] * 8, 0), (903, [None] * 8, 0)]
    return spark.createDataFrame(rows, "id long, embedding array<float>, label int").repartition(5)


def brute(vectors, query, k, skip=(), keep=lambda i: True):
    rows = vectors.astype("float32").astype(float)
    found = []
    for i, v in enumerate(rows):
        if i not in skip and keep(i) and np.any(v):
            found.append((-round(float(v @ query / np.sqrt(v @ v) / np.sqrt(query @ query)), 12), i))
    return [(i, -s) for s, i in sorted(found)[:k]]


def listed(df, query_id):
    rows = df.filter(F.col("query_id") == query_id).orderBy("rank").collect()
    return [(r["id"], r["similarity"]) for r in rows]


def close(got, want):
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want])


def test_search_matches_brute_force(items, vectors):
    queries = {1: vectors[3].tolist(), 2: vectors[100].tolist(), 3: [1.0] * 8}
    got = similarity.search(items, queries, 7)
    for q, v in queries.items():
        close(listed(got, q), brute(vectors, np.array(v), 7))
    filtered = similarity.search(items, queries, 7, filters={"label": 1})
    close(listed(filtered, 3), brute(vectors, np.ones(8), 7, keep=lambda i: i % 3 == 1))


def test_search_for_more_than_there_is(items, vectors):
    got = similarity.search(items, {1: [1.0] * 8}, 1000)
    assert got.count() == 299  # all but the zero vector and the four unfit ones


def test_many_queries_and_queries_without_direction(items, vectors):
    queries = {i: v.tolist() for i, v in enumerate(np.tile(vectors[:130], (10, 1)))}
    got = similarity.search(items, {**queries, 5000: [0.0] * 8, 5001: []}, 2)
    assert got.count() == 2 * 1300
    close(listed(got, 1203), brute(vectors, vectors[33], 2))


def test_similar_to_leaves_the_item_out(items, vectors):
    close(listed(similarity.similar_to(items, 3, 4), 3), brute(vectors, vectors[3], 4, skip=(3,)))
    assert similarity.similar_to(items, 12345, 4).count() == 0
    assert similarity.similar_to(items, 900, 4).count() == 0


def test_hybrid_search(items, vectors):
    kinds = {"company": items.filter("label = 0"), "event": items.filter("label = 1")}
    got = similarity.hybrid_search(kinds, {1: [1.0] * 8}, 3)
    assert {(r["entity"], r["rank"]) for r in got.collect()} == {(e, n) for e in kinds for n in (1, 2, 3)}
    only = similarity.hybrid_search(kinds, {1: [1.0] * 8}, 3, include=["event"])
    assert {r["entity"] for r in only.collect()} == {"event"}


@pytest.mark.parametrize("cells, block_rows", [(1, 1000), (6, 30)])
def test_all_neighbours_match_brute_force(items, vectors, cells, block_rows):
    got = similarity.similar_items(items, 4, cells=cells, block_rows=block_rows)
    lists = {}
    for r in got.orderBy("id", "rank").collect():
        lists.setdefault(r["id"], []).append((r["neighbour_id"], r["similarity"]))
    assert set(lists) == set(range(300)) - {250}
    rows = vectors.astype("float32").astype(float)
    for i in lists:
        close(lists[i], brute(vectors, rows[i], 4, skip=(i,)))


@pytest.mark.parametrize("task_rows", [32_768, 25])
def test_small_blocks_are_not_sent_to_each_other(items, vectors, monkeypatch, task_rows):
    """However small the blocks asked for, a task holds ``TASK_ROWS`` rows of a cell, and the lists stay exact."""
    dealt, compare = [], similarity._compare_blocks

    def watched(placed, again, pairs, k):
        dealt.extend(pairs.collect())
        return compare(placed, again, pairs, k)

    monkeypatch.setattr(similarity, "_compare_blocks", watched)
    monkeypatch.setattr(similarity, "TASK_ROWS", task_rows)
    monkeypatch.setattr(similarity, "COLUMN_CHUNK", 11)
    got = similarity.similar_items(items, 4, cells=2, block_rows=5)
    blocks = sum({r["r_cell"]: r["r_blocks"] for r in dealt}.values())
    assert blocks == 2 if task_rows > 300 else 200 / 25 <= blocks <= 200 / 25 + 2
    rows = vectors.astype("float32").astype(float)
    lists = {}
    for r in got.orderBy("id", "rank").collect():
        lists.setdefault(r["id"], []).append((r["neighbour_id"], r["similarity"]))
    assert set(lists) == set(range(300)) - {250}
    for i in lists:
        close(lists[i], brute(vectors, rows[i], 4, skip=(i,)))


def test_nearest_breaks_ties_by_column(monkeypatch):
    monkeypatch.setattr(similarity, "COLUMN_CHUNK", 7)
    rng = np.random.default_rng(3)
    left, right = np.sign(rng.normal(size=(20, 3))), np.sign(rng.normal(size=(50, 3)))
    for keep in (1, 4, 50):
        row, column, cosine = similarity._nearest(left, right, keep)
        want = [sorted((-v, c) for c, v in enumerate(values))[:keep] for values in (left @ right.T).tolist()]
        assert list(zip(row.tolist(), (-cosine).tolist(), column.tolist(), strict=True)) == [(r, *x) for r, w in enumerate(want) for x in w]


def test_distant_cells_are_not_compared(spark):
    rng = np.random.default_rng(1)
    centres = np.eye(4)
    rows = [
        (i, (centres[i % 4] + rng.normal(scale=0.01, size=4)).tolist()) for i in range(400)
    ]
    items = spark.createDataFrame(rows, "id long, embedding array<double>")
    units = similarity._unit(pd.Series([r[1] for r in rows[:4]]))
    placed = similarity._place(similarity._fold_copies(items, 3, "id", "embedding"), units)
    pairs = similarity._cell_pairs(placed, units, 3, 50)
    assert sorted((r["r_cell"], r["s_cell"]) for r in pairs.collect()) == [(i, i) for i in range(4)]


def test_cosine_of_columns(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])],
                               "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vector.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(2 ** -0.5) and got[1:] == [None, None]


def test_index_search(items, vectors, tmp_path, spark):
    path = str(tmp_path / "index")
    ann.build_index(items, path, cells=5)
    queries = {1: vectors[3].tolist(), 2: [1.0] * 8}
    exact = similarity.search(items, queries, 5)
    close(listed(ann.search_index(spark, path, queries, 5, probes=5), 1), brute(vectors, vectors[3], 5))
    part = ann.search_index(spark, path, queries, 5, probes=2)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell#" in plan
    row = ann.recall(part, exact).first()
    assert row["wanted"] == 10 and 0 < row["recall"] <= 1
