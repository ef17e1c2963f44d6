"""Approximate search by hyperplane hash tables that are probed near their edges.

Every table hashes a vector to the signs of its products with a few planes. A query looks
into its own bucket and those it would fall into if the planes it lies closest to were
crossed; inside the buckets the ranking is exact. Queries are a table of any size: a block
of them meets a part of the rows in a task, which looks the buckets up there and keeps
``k`` rows per query, so a row is sent once per block of queries, not per table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from riskloom.functions import vector
from riskloom.operators import ranking, similarity
from riskloom.operators.nearest import QUERY_CHUNK, ROW_CHUNK, Nearest
from riskloom.sources import sinks

# Rows of a part, and queries of a block, that meet in one task at most (on average).
PART_ROWS = 131_072
QUERY_ROWS = 8_192
# Queries whose buckets are chosen at a time, and rows that are looked up at a time for a word of queries.
PROBE_CHUNK = 256
WORD_CHUNK = 65_536


def planes(tables: int, bits: int, width: int) -> np.ndarray:
    """Directions of all planes, tables x bits x width, by a rule that SQL can follow.

    Planes of a table are rows of a cosine transform, at right angles to each other, with
    the signs of places flipped in a way of the table's own.
    """
    table, bit, place = np.arange(tables)[:, None, None], np.arange(bits)[None, :, None], np.arange(1, width + 1)[None, None, :]
    flip = np.sin(place * place * (table + 1) * 0.7 + place * (table + 1) * 1.3 + (bit // width) * place)
    wave = np.cos(np.pi * (2 * place - 1) * ((bit * 5 + table) % width) / (2.0 * width))
    return np.where(flip > 0, wave, -wave)


def hashed(units: np.ndarray, tables: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every row in every table, and the products with the planes."""
    products = np.einsum("tbw,nw->ntb", planes(tables, bits, units.shape[1]), units)
    return ((products > 0) << np.arange(bits)).sum(2).astype(np.int32), products


def cheap_crossings(bits: int, probes: int) -> np.ndarray:
    """Sets of planes that can be among the ``probes`` cheapest, sets x planes, for planes in
    order of cost: those that are not preceded by so many others. A set is preceded by those
    that lack some of its planes or have cheaper ones instead."""
    sets = (np.arange(1 << bits)[:, None] >> np.arange(bits)) & 1
    above = np.cumsum(sets[:, ::-1], axis=1)[:, ::-1]  # planes of a set from each place on
    size = np.arange(bits + 1)
    ways = np.tile((size == 0).astype(np.int64), (1 << bits, 1))  # by number of planes chosen so far
    for place in reversed(range(bits)):
        ways[:, 1:] += ways[:, :-1].copy()
        ways[size > above[:, place, None]] = 0
    return sets[ways.sum(axis=1) <= probes].astype(float)


def least_crossings(products: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """Planes crossed, as bits, for the ``probes`` buckets with the least sum of squared
    products over them, rows x probes; ties go to the fewer upper planes."""
    squares, sets = products**2, cheap_crossings(bits, probes)
    out = np.empty((len(squares), probes), np.int32)
    for at in range(0, len(squares), PROBE_CHUNK):
        some = squares[at : at + PROBE_CHUNK]
        order = np.argsort(some, axis=1, kind="stable")
        cost = np.take_along_axis(some, order, 1) @ sets.T
        crossed = ((1 << order).astype(float) @ sets.T).astype(np.int32)
        near = cost <= np.partition(cost, probes - 1, axis=1)[:, probes - 1, None]
        for row in np.flatnonzero(np.count_nonzero(near, axis=1) > probes):
            near[row] = False
            near[row, np.lexsort((crossed[row], cost[row]))[:probes]] = True
        out[at : at + PROBE_CHUNK] = crossed[near].reshape(len(some), probes)
    return out


def probed(units: np.ndarray, tables: int, bits: int, probes: int) -> np.ndarray:
    """Buckets that each row looks into, rows x tables x probes, in no order."""
    buckets, products = hashed(units, tables, bits)
    return np.stack([least_crossings(products[:, t], bits, probes) ^ buckets[:, t, None] for t in range(tables)], 1)


def bit_counts(words: np.ndarray) -> np.ndarray:
    """How many of 64-bit words have each bit set, lowest bit first.

    Three words are added bit by bit into one of sums and one of carries."""
    if len(words) < 512:
        return np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    n = len(words) // 3
    a, b, c = words[:n], words[n : 2 * n], words[2 * n : 3 * n]
    odd = a ^ b
    return bit_counts(odd ^ c) + 2 * bit_counts((a & b) | (odd & c)) + bit_counts(words[3 * n :])


def _units(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)
    rows /= np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
    return rows


def _merge(cosines: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest cosines of every row and their places; ties to the lower place.

    ``places`` holds a place per value. Values of minus infinity stand for none.
    """
    if cosines.shape[1] <= k:
        return cosines, places
    columns = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cosines, columns, 1).min(axis=1)
    for row in np.flatnonzero(((cosines >= least[:, None]).sum(axis=1) > k) & (least > -np.inf)):
        at = np.flatnonzero(cosines[row] >= least[row])
        columns[row] = at[np.lexsort((places[row, at], -cosines[row, at]))[:k]]
    return np.take_along_axis(cosines, columns, 1), np.take_along_axis(places, columns, 1)


def build_index(items: DataFrame, path: str, *, tables: int = 24, bits: int = 12,
                id_col: str = "id", vector_col: str = "embedding") -> int:
    """Write every item once with its bucket in each table; gives the number of rows.

    Vectors without a direction, or of another width than most, can never be hits and are
    left out. The planes follow from the numbers of tables and bits alone; nothing is
    fitted.
    """
    if not 0 < bits <= 16:
        raise ValueError("1 to 16 planes a table")
    width = similarity.common_width(items, vector_col)
    usable = items.filter(vector.measurable(F.col(vector_col), width)).select(
        F.col(id_col), F.col(vector_col).cast("array<double>").alias(vector_col)
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                buckets, _ = hashed(_units(batch, vector_col), tables, bits)
                column = pa.FixedSizeListArray.from_arrays(pa.array(buckets.ravel()), tables).cast(pa.list_(pa.int32()))
                yield batch.append_column("buckets", column)

    schema = T.StructType([*usable.schema.fields, T.StructField("buckets", T.ArrayType(T.IntegerType()))])
    return sinks.write_table(usable.mapInArrow(place, schema), path)


def _for_parts(asked: DataFrame, blocks: int, parts: int) -> DataFrame:
    """Queries with their block, once for each part of the rows."""
    return asked.select(
        "*", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("q_block"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("q_part"),
    )


def _for_blocks(rows: DataFrame, blocks: int, parts: int) -> DataFrame:
    """Rows with their part, once for each block of queries."""
    return rows.select(
        "*", (F.monotonically_increasing_id() % parts).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )


def _in_buckets(bucket: np.ndarray, cells: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Queries and rows that meet in a bucket of one table, chunk by chunk: the queries,
    which of their ``cells`` the bucket is, and the rows."""
    names = np.arange((1 << bits) + 1)
    bucket, wanted = bucket.astype(np.uint16), cells.ravel().astype(np.uint16)  # quick to sort
    rows, asks = np.argsort(bucket, kind="stable"), np.argsort(wanted, kind="stable")
    row_at, ask_at = np.searchsorted(bucket[rows], names), np.searchsorted(wanted[asks], names)
    asks, nth = np.divmod(asks, cells.shape[1])
    for b in np.flatnonzero((np.diff(row_at) > 0) & (np.diff(ask_at) > 0)):
        for at in range(ask_at[b], ask_at[b + 1], QUERY_CHUNK):
            mine = slice(at, min(at + QUERY_CHUNK, ask_at[b + 1]))
            for start in range(row_at[b], row_at[b + 1], ROW_CHUNK):
                yield asks[mine], nth[mine], rows[start : min(start + ROW_CHUNK, row_at[b + 1])]


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, *, probes: int = 80, bits: int = 12,
           id_col: str = "id", vector_col: str = "embedding", query_col: str = "query_id") -> DataFrame:
    """Top ``k`` of the probed rows for each row of ``queries`` (query_id, vector).

    Gives ``(query_id, <id_col>, similarity, rank, comparisons)``; ``comparisons`` counts the
    rows that the query met in all tables; a row met in several counts each time. A query vector
    without direction, or of another width than the index, has no hits.
    """
    index = spark.read.parquet(path)
    first = index.select(F.size("buckets").alias("tables"), F.size(vector_col).alias("width")).first()
    tables, width = (first["tables"], first["width"]) if first else (1, 1)
    parts = max(1, math.ceil(index.count() / PART_ROWS))
    asked = queries.filter(vector.measurable(F.col(vector_col), width)).select(
        F.col(query_col).alias("query_id"), F.col(vector_col).cast("array<double>").alias("query_vector")
    )
    blocks = max(1, math.ceil(asked.count() / QUERY_ROWS))
    asked = _for_parts(asked, blocks, parts)
    placed = _for_blocks(index.select(id_col, vector_col, "buckets"), blocks, parts)
    schema = T.StructType([
        T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField(id_col, index.schema[id_col].dataType),
        T.StructField("similarity", T.DoubleType()), T.StructField("comparisons", T.LongType()),
    ])
    arrow, probes = similarity._arrow_schema(schema), min(probes, 1 << bits)

    def meet(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        if not rows.num_rows or not wanted.num_rows:
            return arrow.empty_table()
        by_id = pc.sort_indices(rows[id_col])
        ids = rows[id_col].combine_chunks().take(by_id).dictionary_encode("encode")  # codes rise with the ids
        place, by_id = ids.indices.to_numpy(), by_id.to_numpy()
        buckets = rows["buckets"].combine_chunks().flatten().to_numpy().reshape(-1, tables)[by_id]
        units, asks = np.empty((len(place), width)), _units(wanted, "query_vector")
        to, at = np.argsort(by_id), 0
        for batch in rows.to_batches():
            units[to[at : at + batch.num_rows]] = _units(batch, vector_col)
            at += batch.num_rows
        del rows
        best = Nearest(asks, units, k, place=place, kind=buckets)
        buckets = buckets[best.rows]
        own, products = hashed(asks, tables, bits)
        read = np.zeros(len(asks), np.int64)
        for t in range(tables):
            bucket, cells = buckets[:, t], least_crossings(products[:, t], bits, probes) ^ own[:, t, None]
            read += np.bincount(bucket, best.counts, 1 << bits).astype(np.int64)[cells].sum(axis=1)
            if t == 0 and probes >= k:
                # The nearest rows of the first table's buckets are all different.
                tops = np.full(cells.shape, -np.inf, np.float32)
                for askers, nth, some in _in_buckets(bucket, cells, bits):
                    tops[askers, nth] = np.maximum(tops[askers, nth], best.products(askers, some).max(axis=1))
                best.raise_bar(np.arange(len(asks)), tops)
            for askers, _, some in _in_buckets(bucket, cells, bits):
                best.sift(askers, some)
            best.settle()
        query, row, cosine = best.result()
        first = np.diff(query, prepend=-1) > 0
        return pa.Table.from_arrays(
            [wanted["query_id"].combine_chunks().take(pa.array(query)), ids.dictionary.take(pa.array(place[row])),
             pa.array(cosine), pa.array(np.where(first, read[query], 0))], schema=arrow
        )

    found = placed.groupBy("part", "block").cogroup(asked.groupBy("q_part", "q_block")).applyInArrow(meet, schema)
    # A row per hit of a part, so the window over a query is short; the search stands once in the plan.
    single = found.filter("query_id IS NOT NULL").groupBy("query_id", id_col).agg(
        F.max("similarity").alias("similarity"), F.sum("comparisons").alias("comparisons")
    ).withColumn("comparisons", F.sum("comparisons").over(Window.partitionBy("query_id")))
    order = [F.col("similarity").desc(), F.col(id_col).asc()]
    return ranking.top_k_per_group(single, ["query_id"], order, k).select("query_id", id_col, "similarity", "rank", "comparisons")


def rows_read(spark: SparkSession, path: str, queries: DataFrame, *, probes: int = 80, bits: int = 12,
              vector_col: str = "embedding", query_col: str = "query_id") -> DataFrame:
    """How many different rows a search compares with each query: query_id, rows_read.

    A task holds the buckets of one part of the rows and one block of queries; no pairs
    are made: a row looks up which of 64 queries read its bucket, table by table. Queries
    without direction or of another width give no row.
    """
    index = spark.read.parquet(path)
    first = index.select(F.size("buckets").alias("tables"), F.size(vector_col).alias("width")).first()
    tables, width = (first["tables"], first["width"]) if first else (1, 1)
    parts = max(1, math.ceil(index.count() / (2 * PART_ROWS)))  # buckets alone are narrow
    asked = queries.filter(vector.measurable(F.col(vector_col), width)).select(
        F.col(query_col).alias("query_id"), F.col(vector_col).cast("array<double>").alias("query_vector")
    )
    blocks = max(1, math.ceil(asked.count() / QUERY_ROWS))
    asked = _for_parts(asked, blocks, parts)
    rows = _for_blocks(index.select("buckets"), blocks, parts)
    schema = T.StructType([asked.schema["query_id"], T.StructField("n", T.LongType())])
    arrow, probes = similarity._arrow_schema(schema), min(probes, 1 << bits)

    def count(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        if not rows.num_rows or not wanted.num_rows:
            return arrow.empty_table()
        buckets = rows["buckets"].combine_chunks().flatten().to_numpy().reshape(-1, tables).T.astype(np.intp, order="C")
        asks = _units(wanted, "query_vector")
        n = np.zeros(len(asks), np.int64)
        first_cell = (np.arange(tables) << bits)[:, None]
        for at in range(0, len(asks), 64):
            if at % (4 * PROBE_CHUNK) == 0:
                probes_of = probed(asks[at : at + 4 * PROBE_CHUNK], tables, bits, probes) + first_cell
            # A bit per query: the buckets it looks into.
            looked = np.zeros(tables << bits, np.uint64)
            cells = probes_of[at % (4 * PROBE_CHUNK) :][:64]
            for query, mine in enumerate(cells):
                looked[mine.ravel()] |= np.uint64(1 << query)
            looked = looked.reshape(tables, -1)
            for start in range(0, buckets.shape[1], WORD_CHUNK):
                some = buckets[:, start : start + WORD_CHUNK]
                met = looked[0].take(some[0])
                for t in range(1, tables):
                    met |= looked[t].take(some[t])
                n[at : at + 64] += bit_counts(met)[: len(cells)]
        return pa.Table.from_arrays([wanted["query_id"].combine_chunks(), pa.array(n)], schema=arrow)

    found = rows.groupBy("part", "block").cogroup(asked.groupBy("q_part", "q_block")).applyInArrow(count, schema)
    return found.groupBy("query_id").agg(F.sum("n").alias("rows_read"))
