"""Connected components by alternating large and small stars.

Edges, labels and stars stay distributed; each round is written to the shared folder, so
lineage does not grow. Nodes may be of any ordered type. Only a count and a checksum per
round reach the driver. What a round costs the driver is its tasks: three stages after shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _attach(edges: DataFrame, lowest: DataFrame) -> DataFrame:
    return edges.join(lowest, "u")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; root is the component's least node.

    Loops and repeated edges do no harm; nulls are left out. No edges give no rows.
    """
    now = stored(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "star-0",
    )
    mark = _mark(now)
    turn = 0
    while True:
        turn += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m"))
        # Every edge gives one row, so these are no more than the edges and need no ``distinct``.
        # They are used twice below; stored, they are joined once.
        large = stored(
            _attach(both, lowest.select("u", F.least("u", "m").alias("m")))
            .where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), f"star-{turn}-large",
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _attach(large, least).select("m", F.explode(F.array("u", "v")).alias("u")).where("u <> m")
        following = stored(small.select("u", F.col("m").alias("v")).distinct(), f"star-{turn}")
        after = _mark(following)
        if after == mark:
            break
        now, mark = following, after
    members = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    # A node has one root; grouped by node, the rows need no second shuffle to be joined.
    return members.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
