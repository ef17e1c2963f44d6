"""Approximate search: vectors stored by k-means cell, only near cells are read."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.functions import vector
from riskloom.operators import similarity


def build_index(items: DataFrame, path: str, *, cells: int = 64, id_col: str = "id",
                vector_col: str = "embedding", seed: int = 17) -> None:
    """Write all items partitioned by cell, and the cell centres beside them.

    The centres are fitted on all rows. Vectors without a direction, or of another width
    than most, can never be hits and are left out.
    ``rebalance`` sizes the output files and splits a cell that holds far more rows
    than the others over several tasks.
    """
    width = similarity.common_width(items, vector_col)
    unit = F.transform(
        F.col(vector_col).cast("array<double>"),
        lambda x: F.try_divide(x, F.col("_length")),
    )
    ready = (
        items.filter(vector.measurable(F.col(vector_col), width))
        .withColumn("_length", vector.norm(F.col(vector_col)))
        .withColumn("features", array_to_vector(unit))
        .drop("_length")
    )
    model: KMeansModel = KMeans(
        k=cells, seed=seed, maxIter=10, featuresCol="features", predictionCol="cell"
    ).fit(ready.select("features"))
    placed = model.transform(ready).drop("features")
    placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/items")
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    items.sparkSession.createDataFrame(centres, "cell int, centre array<double>").write.mode(
        "overwrite"
    ).parquet(f"{path}/centres")


def search_index(spark: SparkSession, path: str, queries: dict[int, Sequence[float]], k: int, *,
                 probes: int = 8, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """Top ``k`` per query among the ``probes`` cells nearest to it.

    The cells are chosen on the driver from the centres (as many rows as cells), so the
    scan is pruned to their partitions; inside them the ranking is exact. All queries
    share one scan, and each sees only its own cells.
    """
    centres = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    matrix = np.array([c["centre"] for c in centres])
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    cells = {
        query_id: {
            centres[i]["cell"]
            for i in np.argsort(-(matrix @ np.asarray(values, dtype=float)), kind="stable")[:probes]
        }
        for query_id, values in queries.items()
    }
    items = spark.read.parquet(f"{path}/items").filter(F.col("cell").isin(*set().union(*cells.values())))
    return similarity.search(items, queries, k, id_col=id_col, vector_col=vector_col, scope=("cell", cells))


def recall(approximate: DataFrame, exact: DataFrame, id_col: str = "id") -> DataFrame:
    """Share of the exact hits that the approximate search found."""
    hits = exact.join(approximate.select("query_id", id_col), ["query_id", id_col], "left_semi")
    return (
        hits.agg(F.count(F.lit(1)).alias("found"))
        .select("found", exact.agg(F.count(F.lit(1))).scalar().alias("wanted"))
        .withColumn("recall", F.try_divide("found", "wanted"))
    )
