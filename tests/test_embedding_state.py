import pytest
from pyspark.sql import functions as F

from riskloom.operators import embedding, embedding_state as state
from riskloom.sources import sinks


def items(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id long, text string")


def embed(df):
    return embedding.embed_by_hashing(df, width=16)


def vectors(spark, root, like):
    rows = state.current(spark, root, state.state_schema(like, embed)).collect()
    assert len({r.id for r in rows}) == len(rows)
    return {r.id: (r.text_content, list(r.embedding)) for r in rows}


def changes(df):
    return {r.id: r.change for r in df.collect()}


def test_new_changed_gone(spark, tmp_path):
    root = str(tmp_path)
    first = {i: f"text number {i} of many" for i in range(40)}
    assert set(changes(state.refresh(items(spark, first), root, embed)).values()) == {"new"}
    second = {i: t for i, t in first.items() if i != 3} | {7: "quite another text", 50: "an item that is new", 9: "short"}
    found = changes(state.refresh(items(spark, second), root, embed))
    assert {i: c for i, c in found.items() if c != "same"} == {3: "gone", 7: "changed", 50: "new", 9: "gone"}
    want = items(spark, {i: t for i, t in second.items() if i != 9})
    assert vectors(spark, root, want) == {r.id: (r.text_content, list(r.embedding)) for r in embed(want).collect()}


def test_only_touched_buckets_are_written(spark, tmp_path):
    root = str(tmp_path)
    first = {i: f"text number {i} of many" for i in range(60)}
    state.refresh(items(spark, first), root, embed, buckets=8)
    before = sinks.published(spark, root)
    state.refresh(items(spark, first | {5: "changed text of five"}), root, embed, buckets=5)  # stays at 8
    after = sinks.published(spark, root)
    assert set(after) == set(before) and sum(after[b] != before[b] for b in before) == 1
    embedded = spark.sparkContext.accumulator(0)

    def counting(df):
        def fn(texts):
            embedded.add(len(texts))
            return [[1.0] for _ in texts]
        return embedding.embed_texts(df, fn, "ones")

    root = str(tmp_path / "counted")
    state.refresh(items(spark, first), root, counting, buckets=8)
    first_run = embedded.value
    state.refresh(items(spark, first | {5: "changed text of five"}), root, counting, buckets=8)
    assert first_run == 60 and embedded.value == 61


def test_unchanged_items_publish_nothing(spark, tmp_path):
    texts = {1: "a text of its own", 2: "another text here"}
    state.refresh(items(spark, texts), str(tmp_path), embed)
    state.refresh(items(spark, texts), str(tmp_path), embed)
    assert spark.read.parquet(f"{tmp_path}/{sinks.MANIFEST}").count() == 1
    state.refresh(items(spark, texts), str(tmp_path), embed, version="2")
    assert spark.read.parquet(f"{tmp_path}/{sinks.MANIFEST}").count() == 2


def test_all_gone_and_no_items(spark, tmp_path):
    none = items(spark, {1: "x"}).limit(0)
    assert changes(state.refresh(none, str(tmp_path), embed)) == {}
    state.refresh(items(spark, {1: "a text of its own", None: "a text without id"}), str(tmp_path), embed)
    assert set(vectors(spark, str(tmp_path), none)) == {1}
    assert changes(state.refresh(none, str(tmp_path), embed)) == {1: "gone"}
    assert vectors(spark, str(tmp_path), none) == {}


def test_repeated_ids_and_failures_leave_the_state(spark, tmp_path):
    root = str(tmp_path)
    good = items(spark, {1: "a text of its own"})
    state.refresh(good, root, embed)
    with pytest.raises(ValueError, match="more than once"):
        state.refresh(good.union(good).union(items(spark, {2: "another text here"})), root, embed)

    def failing(df):
        return embed(df).withColumn("text_content", F.raise_error(F.lit("no model")).cast("string"))

    with pytest.raises(Exception, match="no model"):
        state.refresh(items(spark, {1: "a changed text here"}), root, failing)
    assert vectors(spark, root, good)[1][0] == "a text of its own"
