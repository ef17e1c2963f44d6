"""What the pipeline's first stages ask of the driver."""

import random
import tracemalloc

import numpy as np

from riskloom.llm import components as stars
from riskloom.llm import quality_knn


def _plain_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {x: find(x) for x in root}


def test_components_are_those_of_a_plain_search(spark):
    draw = random.Random(3)
    hub = [(0, n) for n in range(1, 40)]
    chain = [(n, n + 1) for n in range(100, 130)]
    loose = [(draw.randrange(200, 400), draw.randrange(200, 400)) for _ in range(150)]
    edges = [*hub, *chain, *chain, *loose, (7, 7), (90, 90), (None, 3), (3, None)]
    for kind, name in (("long", lambda n: n), ("string", lambda n: None if n is None else f"k{n}")):
        named = [(name(a), name(b)) for a, b in edges]
        found = stars.components(spark.createDataFrame(named, f"a {kind}, b {kind}"), "a", "b").collect()
        assert len({r.node for r in found}) == len(found)
        assert {r.node: r.root for r in found} == _plain_components(named)
    assert stars.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_a_round_of_stars_has_few_shuffles(spark, monkeypatch):
    """Every shuffle of a round is a stage of tasks whose state the driver keeps."""
    plans = {}

    def seen(df, label, stored=stars.stored):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, label)

    monkeypatch.setattr(stars, "stored", seen)
    found = stars.components(spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long"), "a", "b")
    assert {(r.node, r.root) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (4, 1)}
    assert sum(plans[label].count("Exchange hashpartitioning") for label in plans if label.startswith("star-1")) <= 5


def test_the_fit_takes_the_place_of_its_counts():
    draw = np.random.default_rng(5)
    counts = (draw.random((1024, quality_knn.TERMS + quality_knn.EXTRA)) < 0.05).astype(np.float32) * draw.integers(1, 9, (1024, 1)).astype(np.float32)
    labels = (np.arange(1024) % 2).astype(np.float32)
    idf = (np.log((1 + 1024) / (1 + (counts[:, : quality_knn.TERMS] > 0).sum(0))) + 1).astype(np.float32)
    want = np.log1p(counts)
    want[:, : quality_knn.TERMS] *= idf
    for a, b, weight in quality_knn.KINDS:
        want[:, a:b] *= weight / np.linalg.norm(want[:, a:b], axis=1, keepdims=True)
    want[:, quality_knn.TERMS] = np.sqrt(counts[:, quality_knn.TERMS]) * (quality_knn.REPEAT_WEIGHT / 4)
    want[:, quality_knn.TERMS + 1 :] = 0
    assert (quality_knn.weighted(counts, idf) == want).all()

    tracemalloc.start()
    model = quality_knn.fit(counts, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (model["mean"] == want.mean(0)).all()
    assert peak < 0.7 * counts.nbytes
