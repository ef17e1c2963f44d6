"""Text search over inverted lists against all scores computed plainly."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from riskloom.operators import word_index
from riskloom.plans import bindings as b


def sparse(text, width=1024):
    counts = Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % width for w in text.lower().split())
    norm = max(math.sqrt(sum(n * n for n in counts.values())), 1.0)
    return {p: float(np.float32(n / norm)) for p, n in counts.items()}


def plainly(texts, query, k, width=1024):
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    q = sparse(query, width)
    found = []
    for i, t in texts.items():
        if t is not None and len(t) >= 10 and t.split():
            v = sparse(t, width)
            found.append((-round(sum(x * q.get(p, 0.0) for p, x in v.items()) / length(v) / length(q), 12), i))
    return [(i, -s) for s, i in sorted(found)[:k]]


@pytest.fixture(scope="module")
def texts(spark, data):
    rows = {r["doc_id"]: r["text"] for r in b.table(spark, data, "documents").collect()}
    return rows | {9001: None, 9002: "short", 9003: " " * 20, 9004: "common " * 50 + "rare", 9005: "common " * 50 + "rare", 9006: "the rarest-word-of-all once"}


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("words") / "index")
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    assert word_index.build_index(df, path) == sum(t is not None and len(t) >= 10 and bool(t.split()) for t in texts.values())
    return path


def test_hits_are_exact(spark, index, texts):
    asked = {1: "the license of this document", 2: "rare common things", 3: "rarest-word-of-all", 4: "no such words anywhere zzqx",
             5: next(t for t in texts.values() if t and len(t) > 400)}
    queries = spark.createDataFrame([*asked.items(), (6, "short"), (7, None), (8, " " * 30)], "query_id long, text string")
    got = {}
    for r in word_index.search(spark, index, queries, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["similarity"]))
    assert set(got) == set(asked)
    for q, text in asked.items():
        want = plainly(texts, text, 7)
        assert np.allclose([s for _, s in got[q]], [s for _, s in want], atol=1e-11)
        assert [i for i, _ in got[q]] == [i for i, _ in want]


def test_weak_lists_are_skipped(spark, tmp_path):
    """Common words cannot bring in a document where rare ones have filled the list."""
    rows = [(i, "common words in every text " + ("needle haystack" if i < 5 else f"filler{i} other{i}")) for i in range(200)]
    path = str(tmp_path / "index")
    word_index.build_index(spark.createDataFrame(rows, "id long, text string"), path)
    queries = spark.createDataFrame([(1, "needle haystack needle haystack needle common")], "query_id long, text string")
    asked = word_index.hashed_words(queries, id_col="query_id")
    named = word_index.asked_lists(spark, path, asked)
    lists = spark.read.parquet(f"{path}/lists")
    needed = word_index.needed_lists(named, word_index.least_scores(lists, named, 3)).collect()
    common = word_index.place_of("common", 1024)
    assert named.count() == 3 and common not in {r["place"] for r in needed} and needed[0]["rest"] > 0
    hits = word_index.search(spark, path, queries, 3).orderBy("rank").collect()
    assert [r["id"] for r in hits] == [0, 1, 2]


def test_no_documents_and_no_queries(spark, index, tmp_path):
    empty = spark.createDataFrame([], "id long, text string")
    path = str(tmp_path / "none")
    assert word_index.build_index(empty, path) == 0
    queries = spark.createDataFrame([(1, "some words to look for")], "query_id long, text string")
    assert word_index.search(spark, path, queries, 3).collect() == []
    assert word_index.search(spark, index, queries.limit(0), 3).collect() == []


def test_words_are_counted_in_parts(spark, monkeypatch):
    """No more words than ``WORDS_AT_ONCE`` are counted together, but for a text that has more alone."""
    rows = [(i, " ".join(f"w{i + j}" for j in range(5 + i % 40))) for i in range(300)] + [(900, "long " * 500), (901, " " * 20)]
    docs = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    counted = word_index.counted

    def watched(words, width):
        assert len(words.flatten()) <= 100 or len(words) == 1
        return counted(words, width)

    monkeypatch.setattr(word_index, "counted", watched)
    monkeypatch.setattr(word_index, "WORDS_AT_ONCE", 100)
    got = {r["id"]: dict(zip(r["places"], r["weights"], strict=True)) for r in word_index.hashed_words(docs).collect()}
    assert got == {i: sparse(text) for i, text in rows}
