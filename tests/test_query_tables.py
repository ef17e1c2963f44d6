"""Searches whose queries are a table: exact by blocks, and by hash tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_similarity import brute, items, listed, vectors  # noqa: F401

from riskloom.operators import hyperplanes, query_tables

ODD = [(700, [0.0] * 8), (701, None), (702, [1.0]), (703, [float("nan")] * 8)]


@pytest.fixture(scope="module")
def asked(spark, vectors):  # noqa: F811
    rows = [(i, [float(x) for x in vectors[i]]) for i in range(0, 300, 7)] + ODD
    return spark.createDataFrame(rows, "query_id long, embedding array<double>").repartition(3)


@pytest.mark.parametrize("cells, block_rows, query_rows", [(1, 10_000, 10_000), (6, 30, 10), (40, 5, 1000)])
def test_table_of_queries(items, vectors, asked, cells, block_rows, query_rows):  # noqa: F811
    """A third of all rows are copies; ties go by id."""
    got = query_tables.search_table(items, asked, 6, cells=cells, block_rows=block_rows, query_rows=query_rows)
    lists = {}
    for r in got.orderBy("query_id", "rank").collect():
        lists.setdefault(r["query_id"], []).append((r["id"], r["similarity"]))
    assert set(lists) == {i for i in range(0, 300, 7) if np.any(vectors[i])}
    for i, found in lists.items():
        want = brute(vectors, vectors[i], 6)
        assert [a for a, _ in found] == [a for a, _ in want]
        assert np.allclose([s for _, s in found], [s for _, s in want])


def test_more_hits_than_items_and_no_items(items, asked):  # noqa: F811
    one = asked.filter("query_id = 7")
    assert query_tables.search_table(items, one, 1000, cells=5, block_rows=50).count() == 299
    nothing = query_tables.search_table(items.limit(0), asked, 3)
    assert nothing.columns == ["query_id", "id", "similarity", "rank"] and nothing.count() == 0
    assert query_tables.search_table(items, asked.limit(0), 3).count() == 0


def test_far_cells_are_not_visited(spark):
    rng = np.random.default_rng(1)
    units = np.eye(4)[np.arange(400) % 4] + rng.normal(scale=0.01, size=(400, 4))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    cells = query_tables.Cells(np.eye(4), {c: (100, 0.05) for c in range(4)}, 50)
    assert (cells.home(units, 5).sum(axis=1) == 1).all()
    assert (cells.near(units, np.full(400, 0.99)) == cells.home(units, 5)).all()
    assert cells.near(units, np.full(400, -1.0)).all()


def test_a_hundred_thousand_queries(spark, items, vectors):  # noqa: F811
    """As many queries as asked, in blocks; every one is answered like the first 300."""
    base = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "k long, embedding array<double>")
    queries = spark.range(100_000).withColumnRenamed("id", "query_id").join(F.broadcast(base), F.col("query_id") % 300 == F.col("k")).drop("k")
    got = query_tables.search_table(items, queries, 2, cells=8, block_rows=64, query_rows=4096)
    per = got.groupBy((F.col("query_id") % 300).alias("k"), "rank").agg(
        F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most")
    ).collect()
    assert all(r["least"] == r["most"] and r["n"] == 333 + (r["k"] < 100) for r in per) and len(per) == 2 * 299
    assert {r["rank"]: r["least"] for r in per if r["k"] == 33} == {n + 1: i for n, (i, _) in enumerate(brute(vectors, vectors[33], 2))}


def test_first_k_breaks_ties_by_place():
    values = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [0.1, 0.1, 0.1, 0.1, 0.1]])
    row, column = query_tables.first_k(values, 3)
    assert {(r, c) for r, c in zip(row.tolist(), column.tolist(), strict=True)} == {(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)}


@pytest.fixture(scope="module")
def index(spark, items, tmp_path_factory):  # noqa: F811
    path = str(tmp_path_factory.mktemp("hash") / "index")
    assert hyperplanes.build_index(items, path, tables=4, bits=6) == 299
    return path


@pytest.mark.parametrize("part_rows, query_rows", [(65_536, 8_192), (40, 9)])
def test_all_buckets_give_all_hits(spark, index, vectors, asked, monkeypatch, part_rows, query_rows):  # noqa: F811
    monkeypatch.setattr(hyperplanes, "PART_ROWS", part_rows)
    monkeypatch.setattr(hyperplanes, "QUERY_ROWS", query_rows)
    got = hyperplanes.search(spark, index, asked, 6, probes=64, bits=6)
    for q in (7, 105, 203):
        assert [i for i, _ in listed(got, q)] == [i for i, _ in brute(vectors, vectors[q], 6)]
    assert {r["comparisons"] for r in got.collect()} == {4 * 299}
    read = hyperplanes.rows_read(spark, index, asked, probes=64, bits=6).collect()
    assert {r["rows_read"] for r in read} == {299} and len(read) == 43


def test_part_of_the_buckets(spark, index, vectors, asked):  # noqa: F811
    """Probed buckets hold what the rule says, each item once."""
    got = hyperplanes.search(spark, index, asked, 5, probes=6, bits=6).collect()
    read = {r["query_id"]: r["rows_read"] for r in hyperplanes.rows_read(spark, index, asked, probes=6, bits=6).collect()}
    rows = vectors.astype("float32").astype(float)
    known = [i for i in range(300) if np.any(rows[i])]
    unit = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
    buckets, _ = hyperplanes.hashed(unit, 4, 6)
    for q in (7, 105, 203):
        # Crossing costs add up over the planes crossed; the cheapest cells are looked into.
        _, products = hyperplanes.hashed(vectors[q : q + 1] / np.linalg.norm(vectors[q]), 4, 6)
        met = set()
        for t in range(4):
            cost = {c: sum(products[0, t, j] ** 2 for j in range(6) if (c ^ sum((products[0, t, j] > 0) << j for j in range(6))) >> j & 1) for c in range(64)}
            near = sorted(cost, key=lambda c: cost[c])[:6]
            met |= {i for i in known if buckets[i, t] in near}
        assert read[q] == len(met)
        want = brute(vectors, vectors[q], 5, keep=lambda i: i in met)  # noqa: B023
        assert [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [i for i, _ in want]


def test_a_hot_bucket_is_split(spark, tmp_path, monkeypatch):
    """Copies share their buckets; no task may hold or compare all of them at once."""
    items = spark.createDataFrame([(i, [1.0, 2.0, 3.0, 4.0]) for i in range(1_000)] + [(5_000, [1.0, 2.0, 3.0, 4.5])], "id long, embedding array<float>").repartition(4)
    path = str(tmp_path / "index")
    hyperplanes.build_index(items, path, tables=3, bits=4)
    units = hyperplanes._units

    def watched(batch, name):
        assert len(batch) <= 400
        return units(batch, name)

    monkeypatch.setattr(hyperplanes, "_units", watched)
    monkeypatch.setattr(hyperplanes, "PART_ROWS", 100)
    queries = spark.createDataFrame([(7, [1.0, 2.0, 3.0, 4.5]), (8, [1.0, 2.0, 3.0, 4.0])], "query_id long, embedding array<float>")
    got = hyperplanes.search(spark, path, queries, 4, probes=16, bits=4)
    assert [i for i, _ in listed(got, 7)] == [5_000, 0, 1, 2] and [i for i, _ in listed(got, 8)] == [0, 1, 2, 3]
    assert {r["comparisons"] for r in got.collect()} == {3 * 1_001}


def test_merge_breaks_ties_by_place():
    cosines, places = np.array([[0.5, 0.5, 0.9, 0.5], [-np.inf, -np.inf, 0.1, 0.2]]), np.array([[9, 3, 8, 5], [-1, -1, 4, 2]])
    best, place = hyperplanes._merge(cosines, places, 2)
    assert [sorted(p) for p in place.tolist()] == [[3, 8], [2, 4]] and best.max(axis=1).tolist() == [0.9, 0.2]


def test_planes_of_a_table_are_at_right_angles():
    p = hyperplanes.planes(3, 12, 64)
    for table in p:
        gram = table @ table.T
        assert np.allclose(gram, np.diag(np.diag(gram)), atol=1e-9)


def test_empty_index(spark, items, asked, tmp_path):  # noqa: F811
    path = str(tmp_path / "none")
    assert hyperplanes.build_index(items.limit(0), path, tables=4, bits=6) == 0
    assert hyperplanes.search(spark, path, asked, 5, bits=6).count() == 0
