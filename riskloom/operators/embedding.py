"""Turning texts into vectors, in full or only for items not yet embedded."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from riskloom.operators import integrity, similarity, word_index

MIN_LENGTH = 10
HASHING_MODEL = "hashed-words"
# Texts whose dense vectors a task holds at a time.
CHUNK = 1024


def long_enough(text: Column, least: int = MIN_LENGTH) -> Column:
    """Whether a text holds enough to be embedded."""
    return F.coalesce(F.length(text) >= least, F.lit(False))


def text_counters(df: DataFrame, text: str, least: int = MIN_LENGTH) -> DataFrame:
    """How many texts are processed, skipped and present in all; one pass."""
    good = long_enough(F.col(text), least)
    return df.agg(
        F.count_if(good).alias("processed"),
        F.count_if(~good).alias("skipped"),
        F.count(F.lit(1)).alias("total"),
    )


def embed_texts(df: DataFrame, fn: Callable[[list[str]], Sequence[Sequence[float]]], model: str, *,
                id_col: str = "id", text_col: str = "text", batch: int = 100) -> DataFrame:
    """Embed texts with a function that maps a list of texts to a list of vectors.

    The function sees at most ``batch`` whole texts at a time and runs inside the tasks.
    Texts that are too short are left out.
    """
    schema = T.StructType([
        T.StructField(id_col, df.schema[id_col].dataType),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("text_content", T.StringType()),
        T.StructField("embedding_model", T.StringType()),
    ])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start:start + batch]
                texts = part[text_col].tolist()
                yield pd.DataFrame({
                    id_col: part[id_col].to_numpy(),
                    "embedding": [[float(x) for x in v] for v in fn(texts)],
                    "text_content": texts,
                    "embedding_model": model,
                })

    usable = df.select(id_col, text_col).filter(long_enough(F.col(text_col)))
    return usable.mapInPandas(run, schema)


def embed_by_hashing(df: DataFrame, *, id_col: str = "id", text_col: str = "text",
                     width: int = 1024) -> DataFrame:
    """Embed texts without a model: hashed word counts, scaled to unit length.

    A word's place is given by the first eight hex digits of its MD5, so that vectors can
    be made outside Spark as well. A text without words gets zeros.
    """
    schema = T.StructType([
        T.StructField(id_col, df.schema[id_col].dataType),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("text_content", T.StringType()),
        T.StructField("embedding_model", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(start, CHUNK)
                row, place, count = word_index.counted(batch.column(1), width)
                vectors = np.zeros((batch.num_rows, width), "float32")
                vectors[row, place] = word_index.weighted(row, count, batch.num_rows)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), width).cast(pa.list_(pa.float32()))
                model = pa.array([HASHING_MODEL] * batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), flat, batch.column(2), model], schema.names)

    return word_index.word_columns(df, id_col, text_col, F.col(text_col).alias("text_content")).mapInArrow(run, schema)


def embed_pending(df: DataFrame, done: DataFrame, embed: Callable[[DataFrame], DataFrame], *,
                  id_col: str = "id", limit: int | None = None) -> DataFrame:
    """Embed only the items without a vector; append the result to resume later."""
    return embed(integrity.pending(df, done, id_col, limit=limit))


def refresh_embeddings(items: DataFrame, target: str, embed: Callable[[DataFrame], DataFrame], *,
                       id_col: str = "id", limit: int | None = None) -> DataFrame:
    """Embed what ``target`` does not hold yet and append it there.

    Gives ``(processed, skipped, total)`` of this run. A run that breaks off leaves only
    whole earlier appends, so the next one goes on from there. The counts are taken
    during the write.
    """
    spark = items.sparkSession
    schema = embed(items.limit(0)).schema
    spark.createDataFrame([], schema).write.mode("ignore").parquet(target)
    done = spark.read.schema(schema).parquet(target)
    todo, made = (Observation(f"{n}-{uuid.uuid4().hex}") for n in ("todo", "made"))
    n = F.count(F.lit(1)).alias("n")
    rest = integrity.pending(items, done, id_col, limit=limit).observe(todo, n)
    embed(rest).observe(made, n).write.mode("append").parquet(target)
    total, processed = todo.get["n"], made.get["n"]
    return spark.createDataFrame(
        [(processed, total - processed, total)], "processed long, skipped long, total long"
    )


def query_vectors(spark: SparkSession, texts: dict[int, str],
                  embed: Callable[[DataFrame], DataFrame]) -> dict[int, list[float]]:
    """Vectors of a few query texts, made the same way as those of the items.

    Texts that are too short for an embedding get none.
    """
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    return {r["id"]: list(r["embedding"]) for r in embed(df).select("id", "embedding").collect()}


def search_texts(items: DataFrame, texts: dict[int, str], embed: Callable[[DataFrame], DataFrame], k: int, *,
                 id_col: str = "id", filters: dict | None = None) -> DataFrame:
    """The ``k`` items most similar to each query text."""
    vectors = query_vectors(items.sparkSession, texts, embed)
    return similarity.search(items, vectors, k, id_col=id_col, filters=filters)
