"""A training-data pipeline: documents in, packed sequences out.

Each stage takes the documents that the one before it kept, written as Parquet, and calls
one operator of ``riskloom.llm``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import mixing, ngram_join, packing, quality_knn, substring_dedup
from riskloom.llm.catalog import GOOD, SEQUENCE_TOKENS, table, tokenizer
from riskloom.llm.common import stored


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality_knn.keep(docs, quality_knn.train(docs, table(spark, sf_dir, "labels")), GOOD)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated windows; documents left without words go."""
    return substring_dedup.deduplicated(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences and their token ids.

    Texts that are mixed in several times, or in part, share an id, so pieces hold the tokens."""
    return packing.pack_documents(docs, tokenizer(), SEQUENCE_TOKENS, with_ids=True)


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", one_of_each_class),
    ("substring dedup", without_repeats),
    ("mixing sources", mixed_sources),
    ("best-fit packing", packed),
]

# Votes of nearest neighbours and byte-pair tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
