"""Exact cosine search over entity vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from riskloom.functions import vector
from riskloom.operators import ranking
from riskloom.session import scratch_path
from riskloom.sources import sinks

# Similarities are rounded to this many digits, so that equal directions tie exactly
# and are then ordered by id.
DIGITS = 12
# Rows scored at a time, to bound the memory of a task.
CHUNK = 2048
# Rows of one block compared with another block at a time, and columns of that one.
BLOCK_CHUNK = 512
COLUMN_CHUNK = 4_096
# Rows of a block that a task of an all-pairs comparison holds at least, where a cell has
# them: every row is sent once per block of the others, so small blocks cost a square.
TASK_ROWS = 32_768
# Queries scored against a chunk at a time.
QUERY_CHUNK = 512
# Tasks' lists of one query are merged in so many parts before they meet in one.
MERGE_PARTS = 64


def with_filters(items: DataFrame, filters: dict | None) -> DataFrame:
    """Equality filters, applied before any similarity is computed; None is not given."""
    for column, value in (filters or {}).items():
        if value is not None:
            items = items.filter(F.col(column) == F.lit(value))
    return items


def search(items: DataFrame, queries: dict[int, Sequence[float]], k: int, *,
           id_col: str = "id", vector_col: str = "embedding",
           filters: dict | None = None, scope: tuple[str, dict[int, set]] | None = None) -> DataFrame:
    """The ``k`` most similar items for each query vector.

    Gives ``(query_id, <id_col>, similarity, rank)``. Items are read once; every task
    scores its rows against all query vectors as matrices and keeps ``k`` rows per query,
    so the shuffle carries tasks x queries x k rows however many items there are. The
    lists of a query are merged in parts first, then as one. Vectors that are NULL, of
    another width or without length have no similarity and are left out.
    ``scope`` names a column and, per query, the values of it that the query may see.
    """
    groups = _query_groups(queries)
    id_field = items.schema[id_col]
    schema = T.StructType([
        T.StructField("query_id", T.LongType()),
        T.StructField(id_col, id_field.dataType),
        T.StructField("similarity", T.DoubleType()),
    ])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, pd.DataFrame] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                chunk = batch.slice(start, CHUNK)
                for names, units in groups:
                    part, rows = _dense(chunk, units.shape[1])
                    if not len(rows):
                        continue
                    cosines = np.round(rows @ units.T, DIGITS)
                    ids = part.column(0).to_pandas()
                    seen = part.column(2).to_numpy(zero_copy_only=False) if scope else None
                    for place, name in enumerate(names):
                        found = pd.DataFrame({id_col: ids, "similarity": cosines[:, place]})
                        if scope:
                            found = found[np.isin(seen, list(scope[1][name]))]
                        best[name] = _head(pd.concat([best[name], found]) if name in best else found, id_col, k)
        for name, frame in best.items():
            frame.insert(0, "query_id", name)
            yield pa.RecordBatch.from_pandas(frame, schema=arrow_schema, preserve_index=False)

    arrow_schema = _arrow_schema(schema)
    columns = [id_col, vector_col] + ([scope[0]] if scope else [])
    scored = with_filters(items, filters).select(*columns).mapInArrow(score, schema)
    order = [F.col("similarity").desc(), F.col(id_col).asc()]
    parts = scored.withColumn("part", F.pmod(F.hash(id_col), F.lit(MERGE_PARTS)))
    merged = ranking.top_k_per_group(parts, ["query_id", "part"], order, k).drop("part", "rank")
    return ranking.top_k_per_group(merged, ["query_id"], order, k)


def _query_groups(queries: dict[int, Sequence[float]]) -> list[tuple[list[int], np.ndarray]]:
    """Query names and unit vectors, in blocks of equal width; a query without direction
    has no hits."""
    by_width: dict[int, list[tuple[int, np.ndarray]]] = {}
    for name, values in queries.items():
        row = np.asarray(values, dtype=float)
        length = np.sqrt((row * row).sum())
        if np.isfinite(length) and length > 0:
            by_width.setdefault(len(row), []).append((name, row / length))
    return [
        ([n for n, _ in block], np.stack([v for _, v in block]))
        for same in by_width.values()
        for block in (same[i:i + QUERY_CHUNK] for i in range(0, len(same), QUERY_CHUNK))
    ]


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _dense(chunk: pa.RecordBatch, width: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """Rows whose second column is a vector of the given width with a direction, and
    those vectors as unit rows."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(chunk.column(1)), width), False)
    part = chunk.filter(fits)
    rows = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)
    lengths = np.sqrt((rows * rows).sum(axis=1))
    good = np.isfinite(lengths) & (lengths > 0)
    return part.filter(pa.array(good)), rows[good] / lengths[good, None]


def common_width(items: DataFrame, vector_col: str) -> int | None:
    """The width most vectors have, the larger of equals; None if there is no vector."""
    widths = items.filter(vector.measurable(F.col(vector_col))).groupBy(F.size(vector_col).alias("width")).count()
    first = ranking.top_k(widths, [F.col("count").desc(), F.col("width").desc()], 1).first()
    return first and first["width"]


def _head(frame: pd.DataFrame, id_col: str, k: int) -> pd.DataFrame:
    if len(frame) > k:
        limit = np.partition(frame["similarity"].to_numpy(), -k)[-k]
        frame = frame[frame["similarity"] >= limit]
    return frame.sort_values(["similarity", id_col], ascending=[False, True]).head(k)


def similar_to(items: DataFrame, item_id: int, k: int, *, id_col: str = "id",
               vector_col: str = "embedding") -> DataFrame:
    """The ``k`` items nearest to a given one, itself excluded; unknown id gives no row."""
    row = items.filter(F.col(id_col) == item_id).select(vector_col).first()
    known = row is not None and row[0] is not None
    others = items.filter(F.col(id_col) != item_id if known else F.lit(False))
    return search(others, {item_id: row[0] if known else [1.0]}, k, id_col=id_col, vector_col=vector_col)


def hybrid_search(entities: dict[str, DataFrame], queries: dict[int, Sequence[float]], k: int, *,
                  include: Sequence[str] | None = None, id_col: str = "id",
                  vector_col: str = "embedding") -> DataFrame:
    """Top ``k`` per entity kind and query, for the kinds that are switched on."""
    chosen = [name for name in entities if include is None or name in include]
    return reduce(
        DataFrame.unionByName,
        [
            search(entities[name], queries, k, id_col=id_col, vector_col=vector_col)
            .withColumn("entity", F.lit(name))
            for name in chosen
        ],
    )


def with_attributes(hits: DataFrame, table: DataFrame, id_col: str = "id") -> DataFrame:
    """Hits with the columns of the table they refer to; hits it does not know go."""
    return hits.join(table, id_col)


def sources(hits: DataFrame, companies: DataFrame, events: DataFrame, id_col: str = "id") -> DataFrame:
    """What the hits of a hybrid search refer to, as ``(entity, id, name, detail)``.

    A company shows its name and ticker, an event its kind and date. Few hits are
    broadcast by Spark's own size check.
    """
    wanted = hits.select("query_id", "entity", "rank", id_col)
    named = {
        "company": companies.select(F.col("u3_company_number").alias(id_col), F.col("company_name").alias("name"),
                                    F.col("ticker").alias("detail")),
        "event": events.select(F.col("id").alias(id_col), F.col("action_name").alias("name"),
                               F.col("announcement_date").cast("string").alias("detail")),
    }
    found = [
        table.join(wanted.filter(F.col("entity") == kind), id_col)
        for kind, table in named.items()
    ]
    return reduce(DataFrame.unionByName, found)


def similar_items(items: DataFrame, k: int, *, id_col: str = "id", vector_col: str = "embedding",
                  cells: int = 64, block_rows: int = 8192) -> DataFrame:
    """The ``k`` nearest items of every item, exactly.

    Gives ``(<id_col>, neighbour_id, similarity, rank)``. Vectors without a direction, or
    of another width than most, take no part. The job has four steps:

    1. Equal vectors are folded into one, with the ``k + 1`` lowest ids among them; no
       more of them can ever be listed for one item.
    2. A few vectors, ``cells`` at most and one for ``block_rows`` rows, serve as cell centres.
       Each vector joins its nearest centre, and cells are cut into blocks of about
       ``block_rows`` rows, or ``TASK_ROWS`` if that is more, so a cell that holds a third
       of all rows is simply many blocks.
    3. By the triangle inequality for angles, pairs of cells too far apart to matter are
       discarded. For the rest, pairs of blocks are compared as dense matrices, and
       each comparison emits only ``k + 1`` rows per vector.
    4. The lists are merged and handed to all items that share the vector.
    """
    spark = items.sparkSession
    folded_path = scratch_path(spark, "folded-vectors")
    distinct = sinks.write_table(_fold_copies(items, k, id_col, vector_col), folded_path)
    if not distinct:
        return spark.createDataFrame([], _neighbour_schema(items, id_col))
    folded = spark.read.parquet(folded_path)

    centres = _centres(folded, min(cells, math.ceil(distinct / block_rows)))
    placed_path = scratch_path(spark, "placed-vectors")
    _place(folded, centres).write.parquet(placed_path)
    placed = spark.read.parquet(placed_path)

    pairs = F.broadcast(_cell_pairs(placed, centres, k, max(block_rows, TASK_ROWS)))  # at most cells ** 2 rows
    merged = _compare_blocks(placed, spark.read.parquet(placed_path), pairs, k)

    # Lists hold at most (k + 1) ** 2 entries before and k + 1 after the cut.
    hits = F.flatten(F.collect_list(
        F.transform("s_ids", lambda i: F.struct((-F.col("similarity")).alias("away"), i.alias("id")))
    ))
    lists = merged.groupBy("r_rep").agg(F.slice(F.sort_array(hits), 1, k + 1).alias("hits"))
    by_vector = folded.join(lists, F.col("rep") == F.col("r_rep")).select("vector", "hits")
    kept = F.slice(F.filter("hits", lambda h: h["id"] != F.col("_id")), 1, k)
    return (
        items.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("vector"))
        .join(by_vector, "vector")
        .select("_id", F.posexplode(kept).alias("pos", "hit"))
        .select(
            F.col("_id").alias(id_col),
            F.col("hit.id").alias("neighbour_id"),
            (-F.col("hit.away")).alias("similarity"),
            (F.col("pos") + 1).alias("rank"),
        )
    )


def _neighbour_schema(items: DataFrame, id_col: str) -> T.StructType:
    kind = items.schema[id_col].dataType
    return T.StructType([
        T.StructField(id_col, kind), T.StructField("neighbour_id", kind),
        T.StructField("similarity", T.DoubleType()), T.StructField("rank", T.IntegerType()),
    ])


def _fold_copies(items: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    rows = items.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    width = common_width(items, vector_col)
    measurable = rows.filter(vector.measurable(F.col("vector"), width))
    lowest = ranking.top_k_per_group(measurable, ["vector"], [F.col("id").asc()], k + 1)
    return lowest.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(
        F.element_at("ids", 1).alias("rep"), "ids", "vector"
    )


def _unit(vectors: pd.Series) -> np.ndarray:
    rows = np.stack(vectors.to_numpy())
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _nearest(left: np.ndarray, right: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and rounded cosine of the ``keep`` nearest of ``right`` for each row of ``left``.

    Ties go to the lower column. Columns are compared chunk by chunk, and only cosines that
    reach the last place so far are looked at.
    """
    row, column, cosine = np.empty(0, int), np.empty(0, int), np.empty(0)
    least = np.full(len(left), -np.inf)
    for start in range(0, len(right), COLUMN_CHUNK):
        products = left @ right[start : start + COLUMN_CHUNK].T
        if start == 0 and products.shape[1] > keep:
            least = np.partition(products, -keep, axis=1)[:, -keep]
        new_row, new_column = np.nonzero(products >= (least - 10.0 ** -DIGITS)[:, None])
        row, column = np.r_[row, new_row], np.r_[column, new_column + start]
        cosine = np.r_[cosine, np.round(products[new_row, new_column], DIGITS)]
        order = np.lexsort((column, -cosine, row))
        row, column, cosine = row[order], column[order], cosine[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < keep
        row, column, cosine, place = row[kept], column[kept], cosine[kept], place[kept]
        least[row[place == keep - 1]] = cosine[place == keep - 1]
    return row, column, cosine


def _centres(folded: DataFrame, cells: int) -> np.ndarray:
    picked = ranking.top_k(folded, [F.xxhash64("rep").asc(), F.col("rep").asc()], cells)
    rows = [r["vector"] for r in picked.select("vector").collect()]  # at most `cells` vectors
    return _unit(pd.Series(rows))


def _place(folded: DataFrame, centres: np.ndarray) -> DataFrame:
    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                cosines = np.clip(_unit(frame["vector"]) @ centres.T, -1.0, 1.0)
                cell = cosines.argmax(axis=1)
                angle = np.arccos(cosines[np.arange(len(frame)), cell])
                yield frame.assign(cell=cell.astype("int32"), angle=angle)

    schema = T.StructType([*folded.schema.fields, T.StructField("cell", T.IntegerType()),
                           T.StructField("angle", T.DoubleType())])
    return folded.mapInPandas(nearest, schema)


def _cell_pairs(placed: DataFrame, centres: np.ndarray, k: int, block_rows: int) -> DataFrame:
    """Pairs of cells that can hold neighbours, with the block numbers of each cell."""
    sizes = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("angle").alias("reach")
    ).toPandas().set_index("cell")
    inner = ranking.top_k_per_group(
        placed.select("cell", "angle", "rep"), ["cell"], [F.col("angle").asc(), F.col("rep").asc()], k + 1
    ).toPandas()

    between = np.arccos(np.clip(centres @ centres.T, -1.0, 1.0))
    blocks = np.ceil(sizes["n"] / block_rows).astype(int)
    first = blocks.cumsum() - blocks
    margin = 1e-6
    rows = []
    for r in sizes.index:
        reach = sizes.at[r, "reach"]
        farthest = reach + between[r, inner["cell"]] + inner["angle"].to_numpy()
        bound = np.partition(farthest, k)[k] if len(farthest) > k else np.inf
        for s in sizes.index:
            if between[r, s] - reach - sizes.at[s, "reach"] <= bound + margin:
                rows.append((int(r), int(s), int(first[r]), int(blocks[r]), int(first[s]), int(blocks[s])))
    return placed.sparkSession.createDataFrame(
        rows, "r_cell int, s_cell int, r_first long, r_blocks long, s_first long, s_blocks long"
    )


def _compare_blocks(placed: DataFrame, again: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The ``k + 1`` nearest distinct vectors of every distinct vector, by block pairs.

    ``again`` reads the same rows as ``placed``; the two sides need columns of their own.
    """

    def side(rows: DataFrame, own: str, other: str) -> DataFrame:
        number = F.col(f"{own}_first") + F.pmod(F.xxhash64("rep"), F.col(f"{own}_blocks"))
        others = F.sequence(F.col(f"{other}_first"), F.col(f"{other}_first") + F.col(f"{other}_blocks") - 1)
        return rows.join(pairs, F.col("cell") == F.col(f"{own}_cell")).select(
            number.alias(f"{own}_block"), F.explode(others).alias(f"{other}_block"), "rep", "ids", "vector"
        )

    rep_type, ids_type = placed.schema["rep"].dataType, placed.schema["ids"].dataType
    schema = T.StructType([
        T.StructField("r_rep", rep_type), T.StructField("s_rep", rep_type),
        T.StructField("similarity", T.DoubleType()), T.StructField("s_ids", ids_type),
    ])

    arrow = _arrow_schema(schema)

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        right = right.sort_by("rep")  # ties by `rep`
        units, keep = _unit_rows(right["vector"]), min(k + 1, right.num_rows)
        rows, columns, cosines = [], [], []
        for start in range(0, left.num_rows, BLOCK_CHUNK):
            row, column, cosine = _nearest(_unit_rows(left["vector"].slice(start, BLOCK_CHUNK)), units, keep)
            rows.append(row + start)
            columns.append(column)
            cosines.append(cosine)
        row, column = pa.array(np.concatenate(rows)), pa.array(np.concatenate(columns))
        return pa.Table.from_arrays(
            [left["rep"].take(row), right["rep"].take(column), pa.array(np.concatenate(cosines)), right["ids"].take(column)], schema=arrow
        )

    keys = ["r_block", "s_block"]
    left, right = side(placed, "r", "s"), side(again, "s", "r")
    compared = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(nearest, schema)
    order = [F.col("similarity").desc(), F.col("s_rep").asc()]
    return ranking.top_k_per_group(compared, ["r_rep"], order, k + 1)
