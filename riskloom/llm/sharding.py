"""K-d tree sharding: weighted medians along the widest metadata dimension.

Rows become points: every metadata dimension is scaled to integers over its range. A node
that must hold k shards is cut so that floor(k / 2) / k of its bytes lie on one side, along
the dimension in which its points are spread widest. All nodes of a level are cut
together. A cut is found by histograms: bytes per bin of the node's range, then again
inside the bin that holds the median, until the bin is small enough or one key. Only the
cuts (one number per inner node) reach the driver; rows are placed by one expression.

Keys end in bits of the text's and the row's hash, so ties can be cut: equal texts lie
next to each other and are parted only where a cut falls among them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import stored

DIM_BITS, TEXT_BITS, ROW_BITS = 16, 16, 26
SAME_BITS = 14  # of ROW_BITS: tell rows equal in id and text apart
BINS = 4096
SLICES = 1024
OVERHEAD = 16  # bytes that a row takes besides its text


@dataclass
class Node:
    """Inner node or leaf: ``shards`` of them from ``first`` on."""

    first: int
    shards: int
    dim: int | None = None
    cut: int | None = None
    left: Node | None = None
    right: Node | None = None

    def leaves_below(self):
        if self.left is None:
            yield self
        else:
            yield from self.left.leaves_below()
            yield from self.right.leaves_below()

    def place(self, keys: list[str]) -> Column:
        """Number of the leaf's first shard, as an expression."""
        if self.left is None:
            return F.lit(self.first)
        return F.when(F.col(keys[self.dim]) < self.cut, self.left.place(keys)).otherwise(self.right.place(keys))


def _coordinate(field) -> Column:
    """A dimension as a number: numbers by logarithm of size, all else by hash; null is 0."""
    name, kind = F.col(f"`{field.name}`"), field.dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        x = name.cast("double")
        value = F.signum(x) * F.log1p(F.abs(x))
        return F.coalesce(F.when(F.isnan(value), 0.0).otherwise(value), F.lit(0.0))
    return F.coalesce(F.crc32(name.cast("string")).cast("double"), F.lit(0.0))


def _points(docs: DataFrame, id_col: str, text_col: str, dims: list[str]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(1 << TEXT_BITS)).alias("text_bits"),
        # Rows equal in id and text are told apart by a number that is fixed when they are stored.
        (
            F.shiftleft(F.pmod(F.xxhash64(F.col(id_col).cast("string"), text), F.lit(1 << (ROW_BITS - SAME_BITS))), SAME_BITS)
            + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << SAME_BITS))
        ).alias("row_bits"),
        *[_coordinate(docs.schema[d]).alias(f"x{i}") for i, d in enumerate(dims)],
    )
    return stored(rows, "shard-points")


def _keyed(points: DataFrame, n_dims: int) -> DataFrame:
    """Integer keys k0, k1, ...: the dimension scaled to its range, then text, then row."""
    bounds = points.agg(*[f(f"x{i}").alias(f"{f.__name__}{i}") for i in range(n_dims) for f in (F.min, F.max)]).first()
    low = F.shiftleft(F.col("text_bits"), ROW_BITS) + F.col("row_bits")
    keys = {}
    for i in range(n_dims):
        a, b = bounds[f"min{i}"] or 0.0, bounds[f"max{i}"] or 0.0
        top = (1 << DIM_BITS) - 1
        scaled = F.floor((F.col(f"x{i}") - a) / (b - a) * top).cast("long") if b > a else F.lit(0).cast("long")
        keys[f"k{i}"] = F.shiftleft(scaled, TEXT_BITS + ROW_BITS) + low
    return stored(points.withColumns(keys).drop(*[f"x{i}" for i in range(n_dims)]), "shard-keys")


def _cut_level(rows: DataFrame, root: Node, keys: list[str]) -> bool:
    """Cut every node that still holds several shards; False if there was none."""
    open_nodes = {n.first: n for n in root.leaves_below() if n.shards > 1}
    if not open_nodes:
        return False
    placed = rows.withColumn("node", root.place(keys))
    extents = placed.groupBy("node").agg(
        F.sum("size").alias("bytes"),
        *[f(k).alias(f"{f.__name__}_{k}") for k in keys for f in (F.min, F.max)],
    ).collect()  # one row per node of the level
    at = {}
    for e in extents:
        if e["node"] not in open_nodes:
            continue
        node = open_nodes[e["node"]]
        spans = [e[f"max_{k}"] - e[f"min_{k}"] for k in keys]
        node.dim = max(range(len(keys)), key=lambda i: (spans[i] >> (TEXT_BITS + ROW_BITS), -i))
        k = keys[node.dim]
        wanted = e["bytes"] * (node.shards // 2) / node.shards
        at[node.first] = {"lo": e[f"min_{k}"], "hi": e[f"max_{k}"] + 1, "wanted": wanted, "bytes": e["bytes"]}
    going = dict(at)
    while going:
        steps = {n: max(1, -(-(v["hi"] - v["lo"]) // BINS)) for n, v in going.items()}

        def per_node(kind: str, value, closed) -> Column:
            """A number of the row's node; ``closed`` where the node is not being cut."""
            listed = F.array(*[F.lit(value(n) if n in going else closed).cast(kind) for n in range(root.shards)])
            return F.get(listed, F.col("node"))

        bins = (
            placed.select(
                "node", "size",
                F.get(F.array(*keys), per_node("int", lambda n: open_nodes[n].dim, 0)).alias("key"),
                per_node("long", lambda n: going[n]["lo"], 1).alias("lo"),
                per_node("long", lambda n: going[n]["hi"], 0).alias("hi"),
                per_node("long", lambda n: steps[n], 1).alias("step"),
            )
            .where("key >= lo AND key < hi")
            .groupBy("node", F.expr("(key - lo) DIV step").alias("bin"))
            .agg(F.sum("size").alias("n"))
        )
        up_to = F.sum("n").over(Window.partitionBy("node").orderBy("bin"))
        wanted = per_node("double", lambda n: float(going[n]["wanted"]), 0.0)
        chosen = (
            bins.withColumn("upto", up_to)
            .where(F.col("upto") >= wanted)
            .groupBy("node").agg(F.min(F.struct("bin", "upto", "n")).alias("b"))
        ).collect()  # one row per node of the level
        for row in chosen:
            n, v, step_n = row["node"], going[row["node"]], steps[row["node"]]
            first = v["lo"] + row["b"]["bin"] * step_n
            below, inside = row["b"]["upto"] - row["b"]["n"], row["b"]["n"]
            if step_n == 1 or inside <= v["bytes"] // 20_000:
                # One key, or too little to matter: it goes to the nearer side.
                nearer = v["wanted"] - below < inside / 2
                open_nodes[n].cut = first if nearer else first + step_n
                del going[n]
            else:
                v.update(lo=first, hi=min(v["hi"], first + step_n), wanted=v["wanted"] - below)
        for n in set(going) - {r["node"] for r in chosen}:  # nothing weighs anything there
            open_nodes[n].cut = going[n]["hi"]
            del going[n]
    for node in open_nodes.values():
        half = node.shards // 2
        if node.cut is None:  # no rows
            node.dim, node.cut = 0, 0
        node.left = Node(node.first, half)
        node.right = Node(node.first + half, node.shards - half)
    return True


def build_tree(rows: DataFrame, shards: int, keys: list[str]) -> Node:
    root = Node(0, shards)
    while _cut_level(rows, root, keys):
        pass
    return root


def shard(
    docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
    dims: tuple[str, ...] = ("n_chars", "lang", "source"),
) -> DataFrame:
    """Shards of nearly equal bytes: doc_id, size, text_crc32, shard, slot.

    ``size`` is the text's UTF-8 length plus 16; a null text counts as empty. ``dims`` are
    columns of ``docs``; those that are missing are left out, nulls and NaN count as 0. A
    single row is never cut, so sizes differ by about one row. Repeated rows share a
    shard; ``slot`` numbers the rows of a shard without gaps from 0. The empty table gives
    no rows; where there are fewer rows than shards, some shards stay empty.
    """
    used = [d for d in dims if d in docs.columns]
    points = _points(docs, id_col, text_col, used or [id_col])
    keys = [f"k{i}" for i in range(len(used) or 1)]
    rows = _keyed(points, len(keys))
    tree = build_tree(rows, shards, keys)
    placed = rows.withColumn("shard", tree.place(keys).cast("int"))
    sliced = placed.withColumn("slice", F.pmod(F.col("row_bits"), F.lit(SLICES)))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy("shard", "slice").agg(F.count("*").alias("n"))
        .select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("shard", "slice").orderBy("row_bits", "doc_id", "text_crc32")
    return (
        sliced.withColumn("nth", F.row_number().over(within) - 1)
        .join(offsets, ["shard", "slice"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("nth")).cast("long").alias("slot"))
    )
