"""Ranking inside a task, and how often rows and queries are sent to one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import hyperplanes, nearest, query_tables
from riskloom.plans import text_queries


def unit(rows):
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def brute(asks, units, k, place):
    """Per query the best (cosine, place) pairs, a place once."""
    out = {}
    for q, cosines in enumerate(np.round(asks @ units.T, 12)):
        hits = sorted({(-c, p) for c, p in zip(cosines.tolist(), place.tolist(), strict=True)})
        out[q] = [(p, -c) for c, p in hits[:k]]
    return out


def listed(best, place):
    out = {}
    for q, row, cosine in zip(*(x.tolist() for x in best.result()), strict=True):
        out.setdefault(q, []).append((place[row], cosine))
    return out


@pytest.mark.parametrize("pairs, rows", [(1 << 20, 4_096), (50, 16)])
def test_copies_ties_and_vectors_that_single_precision_confuses(monkeypatch, pairs, rows):
    monkeypatch.setattr(nearest, "PAIRS", pairs)
    monkeypatch.setattr(nearest, "ROW_CHUNK", rows)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    near = base[rng.integers(0, 40, 300)] + rng.normal(size=(300, 16)) * rng.choice([0.0, 1e-9, 1e-5, 0.3], 300)[:, None]
    units, asks = unit(near), unit(np.r_[base[:20], near[:20]])
    place = np.arange(300)
    twice = np.arange(300) // 2  # ids that come twice, as their vectors do
    for at, rows_, places in ((units, 300, place), (units[twice], 300, twice)):
        best = nearest.Nearest(asks, np.ascontiguousarray(at), 7, place=places)
        best.sift_all()
        got, want = listed(best, places), brute(asks, at, 7, places)
        assert len(at) == rows_ and got.keys() == want.keys()
        for q in want:
            assert [p for p, _ in got[q]] == [p for p, _ in want[q]]
            assert np.allclose([c for _, c in got[q]], [c for _, c in want[q]], rtol=0, atol=2e-12)


def test_copies_are_compared_once():
    units = unit(np.repeat(np.random.default_rng(1).normal(size=(3, 8)), [500, 2, 1], axis=0))
    best = nearest.Nearest(units[:1], units, 4)
    assert best.counts.tolist() == [500, 2, 1] and best.rows.tolist() == [0, 500, 502]
    best.sift_all()
    assert best.result()[1].tolist() == [0, 1, 2, 3]
    kinds = (np.arange(503) % 2)[:, None]
    assert nearest.Nearest(units[:1], units, 4, kind=kinds).counts.tolist() == [250, 250, 1, 1, 1]


def test_words_count_their_bits():
    words = np.random.default_rng(2).integers(0, 1 << 63, size=5_003, dtype=np.uint64)
    assert hyperplanes.bit_counts(words).tolist() == [int(((words >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]


@pytest.mark.parametrize("bits, probes", [(8, 20), (8, 256), (5, 1), (10, 100)])
def test_cheapest_crossings_with_ties(bits, probes):
    products = np.random.default_rng(3).integers(-2, 3, size=(200, bits)).astype(float)
    which = (np.arange(1 << bits)[:, None] >> np.arange(bits)) & 1
    want = np.argsort((products**2) @ which.T, axis=1, kind="stable")[:, :probes]
    assert (np.sort(hyperplanes.least_crossings(products, bits, probes), 1) == np.sort(want, 1)).all()


def test_rows_are_not_sent_once_per_table(spark, tmp_path):
    """A row reaches as many tasks as there are blocks of queries, however many tables."""
    items = spark.range(50).select("id", F.array(*[F.rand(i) - 0.5 for i in range(6)]).alias("embedding"))
    path = str(tmp_path / "index")
    hyperplanes.build_index(items, path, tables=5, bits=4)
    asked = spark.read.parquet(path).filter("id < 9").select(F.col("id").alias("query_id"), "embedding")
    found = hyperplanes.search(spark, path, asked, 3, probes=8, bits=4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "posexplode" not in plan
    assert {r["query_id"] for r in found.collect()} == set(range(9))


def test_blocks_visited_by_all_queries_are_not_small(spark, monkeypatch):
    """Queries are sent once per block that they visit."""
    items = spark.range(600).select("id", F.array(*[F.rand(i) - 0.5 for i in range(6)]).alias("embedding"))
    blocks = []
    inner = query_tables.place_items
    monkeypatch.setattr(query_tables, "place_items", lambda *a: blocks.append(inner(*a)) or blocks[-1])
    asked = items.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    assert query_tables.search_table(items, asked, 3, cells=2, block_rows=10).count() == 90
    assert blocks[0].blocks.max() == 1


def test_what_the_promise_uses_twice_is_made_once(spark, tmp_path):
    """Exact hits and rows read are stored; only the hash search is left in the plan."""
    rows = spark.range(60).select(
        F.col("id").alias("vec_id"), F.array(*[(F.rand(i) - 0.5).cast("float") for i in range(64)]).alias("embedding"), F.lit(1).alias("label")
    )
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    promise = text_queries.ann_promise(spark, str(tmp_path))
    assert promise._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInArrow") == 1
    assert [r["queries"] for r in promise.collect()] == [3]
