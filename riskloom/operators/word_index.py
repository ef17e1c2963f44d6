"""Text search over inverted lists of hashed words, skipping lists that cannot matter.

Texts become sparse vectors: a word's place is given by its MD5, its weight by how often
it occurs. The index holds one list per place, clustered by it, and the largest weight of
each list as a bound. A search reads its strongest lists first, which gives a score that
the k-th hit reaches at least; lists whose bounds together stay below it cannot bring in a
document by themselves and are never read, and documents that cannot reach the score with
all that is left are dropped before they are scored. The hits are the exact ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from riskloom.operators import ranking
from riskloom.session import scratch_path
from riskloom.sources import sinks

# A word: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
MIN_LENGTH = 10
DIGITS = 12
SLACK = 1e-9
# Words of a task's texts that are counted at a time, but at least one text.
WORDS_AT_ONCE = 262_144
# Strongest lists that are read for the first scores: those up to this share of all bounds.
FIRST_SHARE = 0.5


def place_of(word: str, width: int) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % width


def counted(words: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and count of the words of each row, by row and place."""
    n = np.diff(words.offsets.to_numpy())
    coded = words.flatten().dictionary_encode()
    place = np.array([place_of(w, width) for w in coded.dictionary.to_pylist()], np.int64)
    keys, count = np.unique(np.repeat(np.arange(len(n)), n) * width + place[coded.indices.to_numpy()], return_counts=True)
    return keys // width, keys % width, count


def weighted(row: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
    """Counts scaled to rows of unit length, in single precision."""
    square = np.bincount(row, weights=count.astype(float) ** 2, minlength=rows)
    return (count / np.maximum(np.sqrt(square), 1.0)[row]).astype("float32")


def word_columns(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Rows with long enough texts: id, words and other columns."""
    usable = df.filter(F.length(text_col) >= MIN_LENGTH)
    return usable.select(id_col, F.regexp_extract_all(F.lower(text_col), F.lit(WORD), F.lit(0)).alias("words"), *more)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows that hold ``WORDS_AT_ONCE`` words together, or one row of more."""
    ends = batch.column(1).offsets.to_numpy()
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + WORDS_AT_ONCE, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def hashed_words(df: DataFrame, *, id_col: str = "id", text_col: str = "text", width: int = 1024) -> DataFrame:
    """Sparse vectors of texts: id, places, weights, length. Texts under 10 characters are
    left out; a text without words has no places."""
    schema = T.StructType([
        T.StructField("id", df.schema[id_col].dataType), T.StructField("places", T.ArrayType(T.IntegerType())),
        T.StructField("weights", T.ArrayType(T.FloatType())), T.StructField("length", T.DoubleType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            n = batch.num_rows
            row, place, count = counted(batch.column(1), width)
            weight = weighted(row, count, n)
            ends = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
            length = np.sqrt(np.bincount(row, weights=weight.astype(float) ** 2, minlength=n))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(ends, pa.array(place, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(weight)), pa.array(length)],
                ["id", "places", "weights", "length"],
            )

    return word_columns(df, id_col, text_col).mapInArrow(run, schema)


def build_index(items: DataFrame, path: str, *, id_col: str = "id", text_col: str = "text", width: int = 1024) -> int:
    """Write documents, inverted lists and the lists' bounds; gives the number of documents.

    Ids are unique. Lists are clustered by place, long ones over several files.
    """
    spark = items.sparkSession
    n = sinks.write_table(hashed_words(items, id_col=id_col, text_col=text_col, width=width).filter("length > 0"), f"{path}/documents")
    documents = spark.read.parquet(f"{path}/documents")
    entries = documents.select("id", "length", F.explode(F.arrays_zip("places", "weights")).alias("e")).select(
        F.col("e.places").alias("place"), "id", (F.col("e.weights").cast("double") / F.col("length")).alias("share")
    )
    sinks.write_table(entries, f"{path}/lists", cluster_by=["place", "id"])
    lists = spark.read.parquet(f"{path}/lists")
    # At most ``width`` rows.
    sinks.write_table(lists.groupBy("place").agg(F.max("share").alias("most"), F.count(F.lit(1)).alias("entries")), f"{path}/bounds")
    return n


def asked_lists(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """The lists that queries (id, places, weights, length) name, with what each can add at most.

    ``above`` and ``below`` sum the bounds of stronger lists, and of this and weaker ones.
    """
    bounds = F.broadcast(spark.read.parquet(f"{path}/bounds"))  # one row per place
    named = asked.select(F.col("id").alias("query_id"), "length", F.explode(F.arrays_zip("places", "weights")).alias("e")).select(
        "query_id", F.col("e.places").alias("place"), (F.col("e.weights").cast("double") / F.col("length")).alias("wanted")
    )
    strongest = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "place")
    weakest = Window.partitionBy("query_id").orderBy(F.col("bound").asc(), F.col("place").desc())
    whole = Window.partitionBy("query_id")
    return (
        named.join(bounds, "place").withColumn("bound", F.col("wanted") * F.col("most"))
        .withColumn("above", F.coalesce(F.sum("bound").over(strongest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("below", F.sum("bound").over(weakest.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("all_bounds", F.sum("bound").over(whole))
    )


def partial_scores(lists: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sum over the wanted lists for each query and document: query_id, id, score."""
    return lists.join(wanted.select("query_id", "place", "wanted"), "place").groupBy("query_id", "id").agg(
        F.sum(F.col("share") * F.col("wanted")).alias("score")
    )


def least_scores(lists: DataFrame, named: DataFrame, k: int) -> DataFrame:
    """A score that the k-th hit of a query reaches: query_id, least (0 where fewer are known)."""
    first = partial_scores(lists, named.filter(F.col("above") < FIRST_SHARE * F.col("all_bounds")))
    top = ranking.top_k_per_group(first, ["query_id"], [F.col("score").desc(), F.col("id").asc()], k)
    return top.groupBy("query_id").agg(
        F.when(F.max("rank") >= k, F.greatest(F.min("score") - SLACK, F.lit(0.0))).otherwise(0.0).alias("least")
    )


def needed_lists(named: DataFrame, least: DataFrame) -> DataFrame:
    """Lists that may bring in a hit by themselves, with ``rest``, what all others can add."""
    known = named.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    skipped = F.col("below") < F.col("least")
    rest = F.coalesce(F.max(F.when(skipped, F.col("below"))).over(Window.partitionBy("query_id")), F.lit(0.0))
    return known.withColumn("rest", rest).filter(~skipped)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, *, query_col: str = "query_id",
           text_col: str = "text", width: int = 1024) -> DataFrame:
    """Top ``k`` documents for each row of ``queries`` (query_id, text), by cosine.

    Gives ``(query_id, id, similarity, rank)``. Query ids are unique; texts under 10
    characters have no hits. Documents that share no word with a query have similarity 0
    and fill up its list by id.
    """
    documents, lists = spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/lists")
    stores = {n: scratch_path(spark, n) for n in ("asked-texts", "named-lists", "needed-lists")}
    hashed_words(queries, id_col=query_col, text_col=text_col, width=width).filter("length > 0").write.parquet(stores["asked-texts"])
    asked = spark.read.parquet(stores["asked-texts"])
    asked_lists(spark, path, asked).write.parquet(stores["named-lists"])
    named = spark.read.parquet(stores["named-lists"])
    needed_lists(named, least_scores(lists, named, k)).write.parquet(stores["needed-lists"])
    needed = spark.read.parquet(stores["needed-lists"])
    places = [r["place"] for r in needed.select("place").distinct().collect()]  # at most ``width``
    reach = needed.groupBy("query_id").agg(F.first("least").alias("least"), F.first("rest").alias("rest"))
    candidates = (
        partial_scores(lists.filter(F.col("place").isin(places)), needed).join(reach, "query_id")
        .filter(F.col("score") + F.col("rest") + SLACK >= F.col("least")).select("query_id", "id")
    )
    # Sparse vectors are fetched for candidates only; words they do not share add nothing.
    words = asked.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("places", "weights")).alias("q")).select(
        "query_id", F.col("q.places").alias("place"), F.col("q.weights").cast("double").alias("query_weight")
    )
    lengths = asked.select(F.col("id").alias("query_id"), F.col("length").alias("query_length"))
    fetched = candidates.join(documents, "id").select("query_id", "id", "length", F.explode(F.arrays_zip("places", "weights")).alias("e"))
    dots = (
        fetched.select("query_id", "id", "length", F.col("e.places").alias("place"), F.col("e.weights").cast("double").alias("weight"))
        .join(words, ["query_id", "place"]).groupBy("query_id", "id", "length").agg(F.sum(F.col("weight") * F.col("query_weight")).alias("dot"))
    )
    scored = dots.join(lengths, "query_id").select(
        "query_id", "id", F.round(F.col("dot") / (F.col("query_length") * F.col("length")), DIGITS).alias("similarity")
    )
    order = [F.col("similarity").desc(), F.col("id").asc()]
    hits = ranking.top_k_per_group(scored, ["query_id"], order, k)
    # Of the 2k lowest ids at least k are not among the hits.
    lowest = [r["id"] for r in ranking.top_k(documents.select("id"), [F.col("id").asc()], 2 * k).collect()]
    filled = asked.select(F.col("id").alias("query_id"), F.explode(F.lit(lowest) if lowest else F.array().cast("array<long>")).alias("id"))
    rest = filled.join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("similarity", F.lit(0.0))
    return ranking.top_k_per_group(hits.drop("rank").unionByName(rest), ["query_id"], order, k)
