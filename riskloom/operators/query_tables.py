"""Exact cosine search for a table of queries of any size.

Items are placed in cells around a few of them, queries meet items block by block as
matrices, and two passes keep most blocks apart: the first compares a query with the
nearest cells only, which gives it a k-th hit; the second visits those other cells that,
by the triangle inequality for angles, could hold a nearer one. Lists are merged by query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from riskloom.functions import vector
from riskloom.operators import hyperplanes, ranking, similarity
from riskloom.operators.nearest import Nearest
from riskloom.session import scratch_path
from riskloom.sources import sinks

QUERY_CHUNK = 256  # queries compared with a block at a time
MARGIN = 1e-6


def first_k(cosines: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` highest values of every row, ties to the lower column."""
    n = cosines.shape[1]
    if n <= k:
        return np.repeat(np.arange(len(cosines)), n), np.tile(np.arange(n), len(cosines))
    columns = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cosines, columns, 1).min(axis=1)
    for row in np.flatnonzero((cosines >= least[:, None]).sum(axis=1) > k):
        above, ties = np.flatnonzero(cosines[row] > least[row]), np.flatnonzero(cosines[row] == least[row])
        columns[row] = np.r_[above, ties[: k - len(above)]]
    return np.repeat(np.arange(len(cosines)), k), columns.ravel()


class Cells:
    """Centres of cells, and per cell the number of items, the widest angle and blocks."""

    def __init__(self, centres: np.ndarray, sizes: dict[int, tuple[int, float]], block_rows: int):
        self.centres = centres
        n = range(len(centres))
        self.count = np.array([sizes.get(c, (0, 0.0))[0] for c in n])
        self.reach = np.array([sizes.get(c, (0, 0.0))[1] for c in n])
        self.blocks = np.ceil(self.count / block_rows).astype(int)

    def angles(self, units: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(units @ self.centres.T, -1.0, 1.0))

    def home(self, units: np.ndarray, k: int) -> np.ndarray:
        """Whether a cell is among the nearest ones that hold ``k`` items together."""
        order = np.argsort(self.angles(units), axis=1, kind="stable")
        before = np.cumsum(self.count[order], axis=1) - self.count[order]
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, before < k, 1)
        return out & (self.count > 0)

    def near(self, units: np.ndarray, worst: np.ndarray) -> np.ndarray:
        """Whether a cell may hold an item at the cosine ``worst`` or nearer."""
        return (self.angles(units) - self.reach <= np.arccos(np.clip(worst, -1.0, 1.0))[:, None] + MARGIN) & (self.count > 0)


def place_items(items: DataFrame, path: str, cells: int, block_rows: int, id_col: str, vector_col: str) -> Cells | None:
    """Write items as unit vectors with cell and block; the cells, or None without items."""
    width = similarity.common_width(items, vector_col)
    usable = items.filter(vector.measurable(F.col(vector_col), width)).select(
        F.col(id_col).alias("item"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    picked = ranking.top_k(usable, [F.xxhash64("item").asc(), F.col("item").asc()], cells).select("vector").collect()
    if not picked:
        return None
    centres = np.array([r["vector"] for r in picked])
    centres /= np.sqrt((centres * centres).sum(axis=1))[:, None]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosines = np.clip(hyperplanes._units(batch, "vector") @ centres.T, -1.0, 1.0)
                cell = cosines.argmax(axis=1)
                angle = np.arccos(cosines[np.arange(len(cell)), cell])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(angle)], ["item", "vector", "cell", "angle"])

    schema = T.StructType([*usable.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    sinks.write_table(usable.mapInArrow(place, schema), path)
    # One row per cell.
    sizes = items.sparkSession.read.parquet(path).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("reach"))
    return Cells(centres, {r["cell"]: (r["n"], r["reach"]) for r in sizes.collect()}, block_rows)


def _compare(placed: DataFrame, asked: DataFrame, cells: Cells, k: int, query_blocks: int, chosen) -> DataFrame:
    """Best items of the chosen cells' blocks for every query: query_id, item, similarity.

    ``chosen`` gives queries x cells from unit vectors and the column ``worst``, the cosine
    below which a query needs no item.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_CHUNK):
                some = batch.slice(at, QUERY_CHUNK)
                wanted = chosen(hyperplanes._units(some, "query_vector"), some.column("worst").to_numpy(zero_copy_only=False))
                query, cell = np.nonzero(wanted)
                n = cells.blocks[cell]
                block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                query, cell = np.repeat(query, n), np.repeat(cell, n)
                yield pa.RecordBatch.from_arrays(
                    [*some.select(["query_id", "query_vector", "worst", "q_block"]).take(pa.array(query)).columns, pa.array(cell, pa.int32()), pa.array(block, pa.int32())],
                    ["query_id", "query_vector", "worst", "q_block", "q_cell", "q_part"],
                )

    dealt = T.StructType([
        *asked.select("query_id", "query_vector", "worst", "q_block").schema.fields,
        T.StructField("q_cell", T.IntegerType()), T.StructField("q_part", T.IntegerType()),
    ])
    schema = T.StructType([asked.schema["query_id"], T.StructField("item", placed.schema["item"].dataType), T.StructField("similarity", T.DoubleType())])
    arrow = similarity._arrow_schema(schema)

    def meet(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        if not rows.num_rows or not wanted.num_rows:
            return arrow.empty_table()
        rows = rows.sort_by("item")  # ties by id
        worst = wanted["worst"].to_numpy()
        best = Nearest(hyperplanes._units(wanted, "query_vector"), hyperplanes._units(rows, "vector"), k,
                       least=np.where(worst > -1.0, worst, -np.inf))
        best.sift_all()
        query, item, cosine = best.result()
        names, ids = wanted["query_id"].combine_chunks(), rows["item"].combine_chunks()
        return pa.Table.from_arrays([names.take(pa.array(query)), ids.take(pa.array(item)), pa.array(cosine)], schema=arrow)

    number = F.lit(0)
    for cell, n in enumerate(cells.blocks.tolist()):
        if n > 1:
            number = F.when(F.col("cell") == cell, F.pmod(F.xxhash64("item"), F.lit(n))).otherwise(number)
    spread = placed.select(
        "item", "vector", "cell", number.cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("i_block"),
    )
    return spread.groupBy("cell", "part", "i_block").cogroup(
        asked.mapInArrow(deal, dealt).groupBy("q_cell", "q_part", "q_block")
    ).applyInArrow(meet, schema)


def search_table(items: DataFrame, queries: DataFrame, k: int, *, id_col: str = "id", vector_col: str = "embedding",
                 query_col: str = "query_id", cells: int = 64, block_rows: int = 8192, query_rows: int = 8192) -> DataFrame:
    """The ``k`` most similar items for every row of ``queries`` (query_id, vector), exactly.

    Gives ``(query_id, <id_col>, similarity, rank)``. Nothing of the queries leaves the
    tasks: a task holds one block of items and one of queries, whatever their numbers.
    Items and queries without a direction, and items of another width than most, take no
    part; queries of another width have no hits. Query ids are unique, ties go by item id.
    """
    spark = items.sparkSession
    items_path, lists_path = scratch_path(spark, "placed-items"), scratch_path(spark, "home-lists")
    # Every query is sent once per block of a cell that it visits, so blocks are not smaller than a task's.
    at = place_items(items, items_path, cells, max(block_rows, similarity.TASK_ROWS), id_col, vector_col)
    asked = queries.select(F.col(query_col).alias("query_id"), F.col(vector_col).cast("array<double>").alias("query_vector"))
    if at is None:
        return asked.limit(0).select("query_id", F.lit(None).cast(items.schema[id_col].dataType).alias(id_col),
                                     F.lit(0.0).alias("similarity"), F.lit(1).alias("rank"))
    placed = spark.read.parquet(items_path)
    asked = asked.filter(vector.measurable(F.col("query_vector"), at.centres.shape[1]))
    blocks = max(1, math.ceil(asked.count() / query_rows))
    asked = asked.withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    order = [F.col("similarity").desc(), F.col("item").asc()]

    first = _compare(placed, asked.withColumn("worst", F.lit(-1.0)), at, k, blocks, lambda units, _: at.home(units, k))
    ranking.top_k_per_group(first, ["query_id"], order, k).write.parquet(lists_path)
    lists = spark.read.parquet(lists_path)
    # A query with fewer than k hits so far may take any item.
    kth = lists.filter(F.col("rank") == k).select(F.col("query_id").alias("listed"), F.col("similarity").alias("kth"))
    rest = asked.join(kth, F.col("query_id") == F.col("listed"), "left").withColumn("worst", F.coalesce("kth", F.lit(-1.0)))
    second = _compare(placed, rest, at, k, blocks, lambda units, worst: at.near(units, worst) & ~at.home(units, k))
    return ranking.top_k_per_group(lists.drop("rank").unionByName(second), ["query_id"], order, k).withColumnRenamed("item", id_col)
