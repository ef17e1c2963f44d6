"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (
    alignment,
    fingerprints,
    html_main,
    mixing,
    ngram_join,
    packing,
    quality_knn,
    quality_rules,
    sharding,
    sql,
    substring_dedup,
    token_counts,
    url_filter,
    vector_codes,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if text is not None:
            SQL[name] = text.strip()
        return fn

    return add


def table(spark: SparkSession, data: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{data}/{name}.parquet")


# Fixed values of the query's contract: host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query("op1_url_filters", sql.URL_FILTERS)
def op1(spark: SparkSession, data: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, data, "pages"), rules)


GOOD = 0.7


@query("op2_quality_classifier")
def op2(spark: SparkSession, data: str) -> DataFrame:
    docs = table(spark, data, "documents")
    model = quality_knn.train(docs, table(spark, data, "labels"))
    return quality_knn.score(docs, model).select(
        "doc_id", quality_knn.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )


@query("op3_quality_rules")
def op3(spark: SparkSession, data: str) -> DataFrame:
    return quality_rules.quality(table(spark, data, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "posterior",
    )


@query("op4_substring_dedup", sql.SUBSTRING_DEDUP)
def op4(spark: SparkSession, data: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, data, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


@query("op5_ngram_jaccard_join", sql.NGRAM_JOIN)
def op5(spark: SparkSession, data: str) -> DataFrame:
    return ngram_join.join(table(spark, data, "documents"))


SEQUENCE_TOKENS = 1024


def tokenizer() -> tuple:
    """Ranks of the vocabulary in byte_bpe_50k.json, its pre-tokenizer's pattern and its special string."""
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, (("<|endoftext|>", 50256),)


@query("op6_best_fit_packing")
def op6(spark: SparkSession, data: str) -> DataFrame:
    return packing.pack_documents(table(spark, data, "documents"), tokenizer(), SEQUENCE_TOKENS)


@query("op7_source_mixing", sql.MIXING)
def op7(spark: SparkSession, data: str) -> DataFrame:
    return mixing.mix(table(spark, data, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_html_extraction")
def op8(spark: SparkSession, data: str) -> DataFrame:
    return html_main.extract(table(spark, data, "pages"))


@query("op9_document_fingerprints")
def op9(spark: SparkSession, data: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, data, "documents"))


SHARDS = 40


@query("op10_sharding")
def op10(spark: SparkSession, data: str) -> DataFrame:
    # Dimensions that equal texts share keep copies together.
    return sharding.shard(table(spark, data, "documents"), SHARDS, dims=("n_chars", "lang")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op11_vector_codes", sql.VECTOR_CODES)
def op11(spark: SparkSession, data: str) -> DataFrame:
    return vector_codes.compress(table(spark, data, "embeddings"))


@query("op12_tokenizer_alignment")
def op12(spark: SparkSession, data: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, data, "documents"), *paths).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


TOKEN_LIMIT = 1024


@query("op13_token_counts")
def op13(spark: SparkSession, data: str) -> DataFrame:
    return token_counts.token_counts(table(spark, data, "documents"), public_tokenizers.path("byte_bpe_50k.json"), TOKEN_LIMIT)
