"""URL filter lists: expand, join on short hash prefixes, confirm, apply precedence.

Every URL is expanded into host suffixes times path prefixes, as lookup services do. The
expansion is limited to the shapes (number of host labels, length of the path) that some
rule has, so it is exact for any prefix and grows with the rules' variety, not with the
URL. Expressions meet the rules in an equi-join on the first 32 bits of their SHA-256; the
full digest then decides. Equal (host, path) pairs are judged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_DIGITS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    shape = r"^([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(rest, shape, 1), UPPER, LOWER)
    path = F.regexp_extract(rest, shape, 2)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _prepared(rules: DataFrame) -> DataFrame:
    """One row per rule text; of rules that contradict each other the block counts."""
    host = F.translate("host", UPPER, LOWER)
    return (
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IN ('allow', 'block')")
        .groupBy(host.alias("rule_host"), F.col("path").alias("rule_path"))
        .agg(F.max(F.col("verdict") == "block").alias("blocks"))
        .withColumn("rule", F.concat("rule_host", "rule_path"))
        .withColumn("digest", F.sha2("rule", 256))
    )


def _expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    labels = F.split(host, r"\.")

    def one(shape: Column) -> Column:
        fits = (F.size(labels) >= shape.n_labels) & (F.length(path) >= shape.n_path)
        suffix = F.array_join(F.slice(labels, -shape.n_labels, shape.n_labels), ".")
        return F.when(fits, F.concat(suffix, F.substring(path, F.lit(1), shape.n_path)))

    listed = F.array(*[
        F.struct(F.lit(a).alias("n_labels"), F.lit(b).alias("n_path")) for a, b in shapes
    ])
    return F.filter(F.transform(listed, one), lambda x: x.isNotNull())


def judge(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """The verdict of the longest rule that fits each URL, ``default`` where none does.

    Returns one row per row of ``pages`` with ``id_col``, host, path, rule and verdict;
    other columns are left out, so their names cannot clash. A rule (host, path, verdict)
    fits its host and all subdomains if the URL's path starts with its path. Of equally
    long rules a block comes first, then the greater text. Null and malformed URLs have an
    empty host and path. Repeated rows each get their row. An empty list of rules judges
    everything by ``default``.
    """
    lists = _prepared(rules)
    # At most (labels of a host) x (lengths of a path) rows, however many rules there are.
    shapes = [
        (r.n_labels, r.n_path)
        for r in lists.select(
            F.size(F.split("rule_host", r"\.")).alias("n_labels"), F.length("rule_path").alias("n_path")
        ).distinct().collect()
    ]
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    if not shapes:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    expanded = (
        urls.select("host", "path").distinct()
        .withColumn("expression", F.explode(_expressions(F.col("host"), F.col("path"), sorted(shapes))))
        .withColumn("full", F.sha2("expression", 256))
        .withColumn("prefix", F.substring("full", 1, PREFIX_DIGITS))
    )
    listed = lists.select(F.substring("digest", 1, PREFIX_DIGITS).alias("prefix"), "digest", "rule", "blocks")
    best = (
        expanded.join(listed, "prefix")
        .where("full = digest")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "blocks", "rule")).alias("best"))
    )
    return urls.join(best, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"),
        F.when(F.col("best").isNull(), F.lit(default))
        .when(F.col("best.blocks"), F.lit("block"))
        .otherwise(F.lit("allow")).alias("verdict"),
    )
