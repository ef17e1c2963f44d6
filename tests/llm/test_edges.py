"""Every operator and pipeline stage on nulls, odd texts, repeated rows, no rows and clashing columns."""

import os
import sys
from array import array
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline
from riskloom.llm import (
    catalog,
    fingerprints,
    html_main,
    mixing,
    ngram_join,
    packing,
    quality_knn,
    quality_rules,
    sharding,
    substring_dedup,
    url_filter,
)


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, None), (3, None, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "quality_rules": lambda s, d: quality_rules.quality(d),
    "knn": lambda s, d: quality_knn.score(d, quality_knn.train(d, labels(s))),
    "dedup": lambda s, d: substring_dedup.remove_repeats(d),
    "join": lambda s, d: ngram_join.join(d),
    "mix": lambda s, d: mixing.mix(d),
    "fingerprints": lambda s, d: fingerprints.compare_with_edits(d),
    "sharding": lambda s, d: sharding.shard(d, 40),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(spark, edge_docs, name):
    rows = OPERATORS[name](spark, edge_docs).collect()
    assert len(rows) == edge_docs.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, edge_docs, name):
    assert OPERATORS[name](spark, edge_docs.limit(0)).collect() == []


def test_packing_edges(spark, edge_docs):
    rows = packing.pack_documents(edge_docs, catalog.tokenizer()).collect()
    assert sum(r.piece == 0 for r in rows) == edge_docs.count()
    assert packing.pack_documents(edge_docs.limit(0), catalog.tokenizer()).collect() == []


def test_pages_edges(spark):
    pages = spark.createDataFrame(
        [(1, None, None, "x"), (None, "", "", "x"), (2, "http://A.Example.ORG/es/1", "<p>x", None), (2, "http://A.Example.ORG/es/1", "<p>x", None), (3, "no scheme", "<", "h")],
        "page_id long, url string, html string, host string",
    )
    rules = spark.createDataFrame(catalog.RULES, "host string, path string, verdict string")
    judged = url_filter.judge(pages, rules)
    assert judged.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted((r.host, r.path, r.rule or "", r.verdict) for r in judged.collect()) == [
        ("", "", "", "allow"), ("", "", "", "allow"), ("", "", "", "allow"),
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("a.example.org", "/es/1", "example.org/es/", "block"),
    ]
    assert url_filter.judge(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}
    assert sorted(r.text for r in html_main.extract(pages).collect()) == ["", "", "<", "x", "x"]
    assert html_main.extract(pages.limit(0)).collect() == []


@pytest.mark.parametrize("rows", [None, 0])
def test_stages(spark, edge_docs, data, rows):
    docs = edge_docs if rows is None else edge_docs.limit(rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns
        out.collect()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert (packed.count() > 0) == (rows is None)


INNER = ["chosen_id", "chosen_key", "nth_same", "words_key", "shares", "share_of", "share_source", "mix_id", "mix_text", "share", "mixed_text", "row", "id", "carried", "n_removed", "group"]


@pytest.mark.parametrize("stage", range(4))
def test_stages_with_names_of_their_own(spark, edge_docs, data, stage):
    """Extra columns that are named like inner ones come through with their values."""
    plain = edge_docs.select("doc_id", "text", "lang", "source", "n_chars")
    extra = plain.selectExpr("*", *[f"concat('{n}', coalesce(doc_id, -1)) AS `{n}`" for n in INNER])
    run = corpus_pipeline.STAGES[stage][1]
    got = run(spark, extra, data)
    assert got.columns == extra.columns
    rows = got.collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.select(*plain.columns).collect())) == sorted(map(key, run(spark, plain, data).collect()))
    assert all(r[n] == f"{n}{-1 if r.doc_id is None else r.doc_id}" for r in rows for n in INNER)


def test_copies_leave_one(spark, edge_docs, data):
    kept = ngram_join.one_of_each(edge_docs)
    plain = [r.doc_id for r in kept.collect() if r.text and r.text.startswith("A plain")]
    assert plain == [5]


def test_packed_sequences_hold_their_tokens(spark, data):
    """Texts that share an id, as the mix makes them, come back from the sequences token by token."""
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [(1, "one text"), (1, "one text"), (1, "a run of its words"), (None, "no id <|endoftext|> here"), (2, ""), (3, None), (4, "many words " * 1_500)]
    texts += [(5, f"short text {i}") for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
    assert packed.where("crc32(ids) <> ids_crc32 OR length(ids) <> 4 * length OR ids IS NULL").count() == 0
    sequences = {}
    for r in packed.orderBy("sequence_id", "offset").collect():
        held = sequences.setdefault(r.sequence_id, [])
        assert r.offset == len(held)
        held.extend(array("I", r.ids))
    assert all(len(held) <= catalog.SEQUENCE_TOKENS for held in sequences.values())
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for _, text in texts:
        ids = [*bpe.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        want.update([tuple(ids[:first]), *(tuple(ids[s : s + 1024]) for s in range(first, len(ids), 1024))])
    places = packed.select("sequence_id", "offset", "length").collect()
    assert Counter(tuple(sequences[s][o : o + n]) for s, o, n in places) == want
