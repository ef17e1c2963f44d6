"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets come from weights, limited by how often a source may be repeated. The mix is then
cut into equal blocks of tokens; seats (one block each) go to sources by the highest
quotients target / (2 j + 1). Seats are dealt to shards in the order of award, which gives
every shard integer quotas close to the overall shares. A source's last block is as much
smaller or larger as its target asks, so a source of less than one block gets its share,
too. The words of a source, its documents in a seeded order, are cut into blocks of that
size, and the blocks are put into a seeded order of their own: shards select their quotas
from it one after the other, each beginning where the one before ended, and at its end the
order begins again. A document is taken as far as its words lie in selected blocks.

Only narrow rows (id, source, size) are shuffled. Positions inside a source come from
slice sums, so a source that holds most rows is spread over 16 ** ``SLICE_DIGITS`` groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import stored, word_count, words

SLICE_DIGITS = 3  # 4,096 slices of a source's seeded order


def targets(sized: DataFrame, weights: tuple[float, ...], ratio: float, repeats: float) -> DataFrame:
    """Per source: source_no, source_size, weight, target.

    Sources are numbered by code point, null last, and take ``weights`` in turn. The mix
    holds ``ratio`` times all tokens. No target exceeds ``repeats`` times its source; the
    excess goes to the others by weight until none is above. Windows here run over one
    row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
        .withColumn("source_no", F.row_number().over(by_name))
        .withColumn(
            "weight",
            F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1),
        )
        .withColumn("most", F.lit(float(repeats)) * F.col("source_size"))
    )
    # In order of the level at which they fill up, sources are full as long as the level
    # that the rest would get lies above their own.
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    level = (F.lit(float(ratio)) * F.sum("source_size").over(everything) - before) / left
    first_open = F.min(F.when(
        F.col("level") * F.col("weight") <= F.col("most"),
        F.struct(F.col("most") / F.col("weight"), "source_no", "level"),
    )).over(everything)
    return (
        ranked.withColumn("level", level)
        .withColumn("open_level", first_open["level"])
        .withColumn("target", F.least(F.col("most"), F.coalesce(F.col("open_level") * F.col("weight"), F.col("most"))))
        .select("source", "source_no", "source_size", "n_docs", "weight", "most", "target")
    )


def with_blocks(sources: DataFrame, blocks: int) -> DataFrame:
    """Sources with mix (words of all targets), n_sources and block_size (words)."""
    everything = Window.partitionBy()
    return (
        sources.withColumn("mix", F.sum(F.floor(F.col("target") + 0.5)).over(everything))
        .withColumn("n_sources", F.count("*").over(everything))
        .withColumn("block_size", F.greatest(F.lit(1), F.floor(F.col("mix") / blocks)).cast("long"))
    )


def apportion(sources: DataFrame, blocks: int, shards: int) -> DataFrame:
    """Sainte-Laguë seats: one row per seat with source_no, block_size and shard.

    About ``blocks`` seats are dealt in all, however large the input, so the single
    ordered pass over the seats has a fixed size. A source gets no more seats than blocks
    fit in its limit. Ties go to the lower source number.
    """
    prepared = (
        with_blocks(sources, blocks)
        .withColumn("seats", F.floor(F.col("mix") / F.col("block_size")))
        # Divisor methods stay within half a seat per source of the exact share.
        .withColumn(
            "highest",
            F.least(
                F.floor(F.col("most") / F.col("block_size")),
                F.ceil(F.col("target") / F.col("block_size")) + 1 + F.ceil(F.col("n_sources") * F.col("target") / F.col("mix")),
            ).cast("long"),
        )
        .where("highest > 0")
    )
    quotients = prepared.select(
        "source_no", "block_size", "seats", "target",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("highest") - 1)).alias("j"),
    ).withColumn("quotient", F.col("target") / (2 * F.col("j") + 1))
    award = F.row_number().over(Window.orderBy(F.col("quotient").desc(), "source_no"))
    return (
        quotients.withColumn("award", award)
        .where("award <= seats")
        .select("source_no", "block_size", "award", F.pmod(F.col("award") - 1, F.lit(shards)).cast("int").alias("shard"))
    )


def shard_quotas(seats: DataFrame) -> DataFrame:
    """Integer quota of blocks per source and shard."""
    return seats.groupBy("source_no", "shard").agg(F.count("*").alias("quota"), F.first("block_size").alias("block_size"))


def shard_words(sources: DataFrame, seats: DataFrame, shards: int) -> DataFrame:
    """Per source: source_no, quota (blocks), due (words), shard_ends (words up to each shard's end).

    ``due`` is the target in whole words; what whole blocks leave or exceed goes to the
    shard of the source's last seat, or to a shard in turn for sources without a seat.
    """
    last = seats.groupBy("source_no").agg(F.max_by("shard", "award").alias("last_shard"))
    per_shard = shard_quotas(seats).groupBy("source_no").agg(
        F.sum("quota").alias("quota"), F.first("block_size").alias("block_size"),
        F.map_from_entries(F.collect_list(F.struct("shard", "quota"))).alias("quotas"),
    )
    known = (
        sources.select("source_no", F.floor(F.col("target") + 0.5).alias("due"))
        .join(per_shard, "source_no", "left").join(last, "source_no", "left")
        .withColumn("last_shard", F.coalesce("last_shard", F.pmod("source_no", F.lit(shards))))
    )
    blocks = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.coalesce(F.try_element_at("quotas", s), F.lit(0)) * F.coalesce("block_size", F.lit(0)),
    )
    # Whole blocks may exceed the words due by less than one: the last seat's shard gives way first.
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda n: F.aggregate(F.slice("blocks", 1, n), F.lit(0).cast("long"), lambda a, x: a + x))
    extra = F.col("due") - F.element_at("whole", -1)
    moved = F.transform("whole", lambda end, i: F.least(F.col("due"), end + F.when(i >= F.col("last_shard"), extra).otherwise(0)))
    rising = F.transform(moved, lambda end, i: F.array_max(F.slice(moved, F.lit(1), i + 1)))
    return (
        known.withColumn("blocks", blocks).withColumn("whole", ends)
        .select("source_no", F.coalesce("quota", F.lit(0)).alias("quota"), "due", rising.alias("shard_ends"))
    )


def select_blocks(quotas: DataFrame, seed: int) -> DataFrame:
    """The blocks of each source (source_no, source_size, block_size, last_pass) and what is selected of them.

    Gives source_no and ``selected``: per block of the source, in the order of its words,
    ``at`` (words before it in the seeded order of blocks) and ``n`` (words of the block
    that the last, partial pass takes). Blocks are selected whole in the seeded order up to
    ``last_pass`` words, but for the one in which they end. The shorter block at a source's
    end comes last. A source has at most as many blocks as the mix, whatever its size.
    """
    blocks = quotas.where("source_size > 0").select(
        "source_no", "source_size", "block_size", "last_pass",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("source_size") - 1) / F.col("block_size")))).alias("block"),
    ).withColumn("words", F.least("block_size", F.col("source_size") - F.col("block") * F.col("block_size")))
    draw = F.md5(F.concat(F.col("source_no").cast("string"), F.lit(":"), F.col("block").cast("string"), F.lit(f":{seed}")))
    seeded = Window.partitionBy("source_no").orderBy(F.col("words") < F.col("block_size"), draw, "block")
    at = F.coalesce(F.sum("words").over(seeded.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.greatest(F.lit(0), F.least(F.col("at") + F.col("words"), F.col("last_pass")) - F.col("at"))
    return (
        blocks.withColumn("at", at).withColumn("n", n).groupBy("source_no")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("block", "at", "n"))), lambda b: F.struct(b["at"].alias("at"), b["n"].alias("n"))).alias("selected"))
    )


def _positions(sized: DataFrame, seed: int) -> DataFrame:
    """``start``: words of the same source before a document in the seeded order."""
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))
    ordered = sized.withColumn("draw", F.md5(name)).withColumn("slice", F.substring("draw", 1, SLICE_DIGITS))
    within = Window.partitionBy("source_no", "slice").orderBy("draw", "doc_id", "size")
    over_slices = Window.partitionBy("source_no").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy("source_no", "slice").agg(F.sum("size").alias("n"))
        .select("source_no", "slice", F.coalesce(F.sum("n").over(over_slices), F.lit(0)).alias("offset"))
    )
    before = F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        ordered.withColumn("before", before)
        .join(offsets, ["source_no", "slice"])
        .withColumn("start", F.col("offset") + F.col("before"))
        .drop("slice", "before", "offset")
    )


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0), ratio: float = 1.5, repeats: int = 2,
    blocks: int = 10_000, shards: int = 8, seed: int = 42,
) -> DataFrame:
    """How many words of each document the mix takes.

    One row per row of ``docs``: doc_id, source, size, source_size, target, quota (blocks
    of the source), full_passes and pieces (runs of the document's words that are taken
    once more: first, from 0, and n), taken, shard (whose quota its first taken word fills;
    null if none is). A document is taken ``full_passes`` times, and once more for the words
    that lie in blocks selected in the source's last, partial pass. No text is taken more
    than ``repeats`` times. Null and empty texts have size 0; a null source is a source of
    its own. Repeated rows are documents of their own. Rows equal in id, source and size may
    swap their places, never their sum. The empty table gives no rows. Reruns agree.
    """
    sized = stored(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    sources = stored(targets(sized, weights, ratio, repeats), "mix-sources")
    quotas = shard_words(sources, apportion(sources, blocks, shards), shards)
    per_source = stored(
        with_blocks(sources, blocks).join(quotas, "source_no")
        .withColumn("full_passes", F.when(F.col("source_size") > 0, F.floor(F.col("due") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("last_pass", F.col("due") - F.col("full_passes") * F.col("source_size"))
        .select("source", "source_no", "source_size", "target", "block_size", "quota", "full_passes", "last_pass", "shard_ends"),
        "mix-quotas",
    )
    names = per_source.select(F.col("source").alias("name"), "source_no")
    numbered = sized.join(names, sized.source.eqNullSafe(names.name)).drop("name")
    selected = per_source.drop("source").join(select_blocks(per_source, seed), "source_no", "left")

    end = F.col("start") + F.col("size")
    first_block = F.floor(F.col("start") / F.col("block_size"))
    last_block = F.floor((end - 1) / F.col("block_size"))

    def piece(block):
        starts = block * F.col("block_size")
        first = F.greatest(F.col("start"), starts)
        held = F.get("selected", block.cast("int"))
        return F.struct(
            (first - F.col("start")).alias("first"),
            F.greatest(F.lit(0), F.least(end, starts + held["n"]) - first).cast("long").alias("n"),
            (held["at"] + first - starts).alias("at"),
        )

    in_blocks = F.when(F.col("size") > 0, F.transform(F.sequence(first_block, last_block), piece))
    again = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["n"])
    # Place of the first taken word in the seeded order of the source's blocks.
    place = F.when(F.col("full_passes") > 0, F.get("held", F.lit(0))["at"]).otherwise(F.get("pieces", F.lit(0))["at"])
    return (
        _positions(numbered, seed).join(selected, "source_no")
        .withColumn("held", in_blocks)
        .withColumn("pieces", F.coalesce(F.filter("held", lambda p: p["n"] > 0), F.array()))
        .withColumn("taken", (F.col("full_passes") * F.col("size") + again).cast("long"))
        .withColumn("place", place)
        .withColumn("shard", F.when(F.col("taken") > 0, F.size(F.filter("shard_ends", lambda end: end <= F.col("place")))))
        .select("doc_id", "source", "size", "source_size", "target", "quota", "full_passes", _runs(F.col("pieces")).alias("pieces"), "taken", "shard")
    )


def _runs(pieces: Column) -> Column:
    """Pieces (first, n) in order, those that follow each other without a gap united."""
    none = F.array().cast("array<struct<first:bigint,n:bigint>>")

    def add(runs, piece):
        last = F.try_element_at(runs, F.lit(-1))
        follows = last["first"] + last["n"] == piece["first"]
        longer = F.struct(last["first"].alias("first"), (last["n"] + piece["n"]).alias("n"))
        single = F.struct(piece["first"].alias("first"), piece["n"].alias("n"))
        return F.when(follows, F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(longer))).otherwise(F.concat(runs, F.array(single)))

    return F.aggregate(pieces, none, add)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (doc_id, text, source and any others) as the mix takes them.

    Whole copies as often as they are taken, plus the runs of words that lie in blocks
    selected in the source's last pass, each a text of its own; ``n_chars`` follows where
    it exists. Same columns as ``docs``.
    Rows are known by id, text and source; equal rows each take one of their shares. Null
    ids and sources are values like others, texts without words are not taken, no rows
    give no rows, and other columns may have any names.
    """
    rows = docs.select(
        F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("id"), "source", F.struct(*docs.columns).alias("row")
    )
    shares = (
        mix(docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("id"), "text", "source"), id_col="id", **options)
        .where("taken > 0")
        .groupBy(F.col("doc_id").alias("share_of"), F.col("source").alias("share_source"))
        .agg(F.sort_array(F.collect_list(F.struct("full_passes", "pieces", "size"))).alias("shares"))
    )
    same = Window.partitionBy("id", "source").orderBy(F.lit(0))
    taken = (
        rows.join(shares, F.col("id").eqNullSafe(F.col("share_of")) & F.col("source").eqNullSafe(F.col("share_source")))
        .select("row", F.get("shares", F.row_number().over(same) - 1).alias("share"))
        .where("share IS NOT NULL")
    )
    text = F.col("row")["text"]
    partial = F.transform("share.pieces", lambda p: F.when(p["n"] == F.col("share.size"), text).otherwise(
        F.array_join(F.slice(words(text), (p["first"] + 1).cast("int"), p["n"].cast("int")), " ")
    ))
    texts = F.concat(F.array_repeat(text, F.col("share.full_passes").cast("int")), partial)
    out = taken.select("row", F.explode(texts).alias("mixed_text"))
    changed = {"text": F.col("mixed_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("mixed_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
