"""Order MinHash fingerprints: sketches that are sensitive to edit distance.

A text's k-mers (runs of ``K`` words) are numbered by occurrence, so repeated k-mers are
different elements. Their hashes fall into ``BINS`` bins by their low bits; in each bin the
two smallest hashes are selected, put in text order and hashed together. Two texts agree in
a bin if they share both k-mers in the same order. One hash per k-mer serves all bins.

DataFrame functions only. A text is handled inside its row: its k-mers are an array, they
are sorted only where some occur twice, and nothing is exploded or shuffled by word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import partitions, stored, words

K = 3
BINS = 64
CANDIDATES = BINS * 16  # hashes looked at: on average 16 per bin, of which 2 are used
BROADCAST_BYTES = 64 << 20  # of texts that follow the slices' last ones
SPREAD = 4096


def _get(array: Column, i: Column | int) -> Column:
    return F.get(array, i)


def sketch(df: DataFrame, text_cols: dict[str, str]) -> DataFrame:
    """Replace text columns by fingerprints (arrays of 64-bit tuple hashes).

    ``text_cols`` maps fingerprint names to text columns; a null text gives a null
    fingerprint, a text without words the empty one. Texts with fewer than K words have
    one k-mer. Built step by step, so that every array is computed once.
    """
    names = list(text_cols)
    keep = [c for c in df.columns if c not in text_cols.values()]

    def step(frame: DataFrame, build) -> DataFrame:
        return frame.select(*keep, *[build(F.col(n)).alias(n) for n in names])


    split = df.select(*keep, *[F.when(F.col(t).isNotNull(), words(F.col(t))).alias(n) for n, t in text_cols.items()])

    def hashes(w: Column) -> Column:
        runs = F.transform(
            F.slice(w, F.lit(1), F.greatest(F.size(w) - (K - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *[_get(w, i + k) for k in range(1, K)]),
        )
        return (
            F.when(F.size(w) >= K, runs)
            .when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " "))))
            .when(w.isNotNull(), F.array().cast("array<bigint>"))
        )

    hashed = step(split, hashes)

    # Occurrence numbers: sort by hash, find where runs of equal hashes start, count on.
    def in_order(h: Column) -> Column:
        return F.when(
            F.size(F.array_distinct(h)) < F.size(h),
            F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        )

    ordered = hashed.select(*keep, *names, *[in_order(F.col(n)).alias(f"{n}_s") for n in names])

    def starts(s: Column) -> Column:
        return F.filter(
            F.transform(s, lambda e, j: F.when((j == 0) | (_get(s, F.greatest(j - 1, F.lit(0))).h != e.h), j)),
            lambda j: j.isNotNull(),
        )

    runs = ordered.select("*", *[starts(F.col(f"{n}_s")).alias(f"{n}_b") for n in names])

    def numbered(h: Column, s: Column, b: Column) -> Column:
        occurrence = F.flatten(F.transform(
            b, lambda x, j: F.sequence(F.lit(0), F.coalesce(_get(b, j + 1), F.size(s)) - x - 1)
        ))
        again = F.zip_with(
            s, occurrence,
            lambda e, o: F.struct(F.when(o == 0, e.h).otherwise(F.xxhash64(e.h, o)).alias("g"), e.i.alias("i")),
        )
        return F.when(s.isNotNull(), F.transform(F.array_sort(F.transform(again, lambda e: F.struct(e.i, e.g))), lambda e: e.g)).otherwise(h)

    unique = runs.select(*keep, *[numbered(F.col(n), F.col(f"{n}_s"), F.col(f"{n}_b")).alias(n) for n in names])

    def binned(g: Column, positions: Column) -> Column:
        return F.array_sort(F.transform(positions, lambda i: F.struct(
            _get(g, i).bitwiseAND(F.lit(BINS - 1).cast("long")).alias("bin"), _get(g, i).alias("g"), i.alias("i")
        )))

    def least_two(s: Column) -> Column:
        return F.filter(s, lambda e, i: (i < 2) | (_get(s, F.greatest(i - 2, F.lit(0))).bin != e.bin))

    # Only the smallest hashes can be selected; a bound in proportion keeps 16 per bin. A
    # text in which some bin has fewer than two below the bound is looked at again, whole.
    def small(g: Column) -> Column:
        bound = F.floor(F.lit(float(2**32) * CANDIDATES) / F.size(g)).cast("long") - 2**31
        return binned(g, F.filter(
            F.transform(g, lambda x, i: F.when((F.size(g) <= CANDIDATES) | (F.shiftright(x, 32) < bound), i)),
            lambda i: i.isNotNull(),
        ))

    def again(g: Column, found: Column) -> Column:
        short = (F.size(g) > CANDIDATES) & (F.size(found) < 2 * BINS)
        return F.when(short, binned(g, F.sequence(F.lit(0), F.size(g) - 1)))

    whole = [F.col(n).alias(f"{n}_g") for n in names]
    sorted_bins = unique.select(*keep, *whole, *[small(F.col(n)).alias(n) for n in names])
    first = sorted_bins.select(*keep, *[f"{n}_g" for n in names], *[least_two(F.col(n)).alias(n) for n in names])
    checked = first.select(*keep, *names, *[again(F.col(f"{n}_g"), F.col(n)).alias(f"{n}_a") for n in names])
    two = checked.select(*keep, *[F.coalesce(least_two(F.col(f"{n}_a")), F.col(n)).alias(n) for n in names])

    def tuples(t: Column) -> Column:
        def one(e: Column, i: Column) -> Column:
            before, after = _get(t, F.greatest(i - 1, F.lit(0))), _get(t, i + 1)
            second = (i > 0) & (before.bin == e.bin)
            first = F.coalesce(after.bin == e.bin, F.lit(False))
            pair = F.when(before.i < e.i, F.xxhash64(before.g, e.g)).otherwise(F.xxhash64(e.g, before.g))
            return F.when(second, pair).when(~first, F.xxhash64(e.g))

        return F.filter(F.transform(t, one), lambda x: x.isNotNull())

    return step(two, tuples)


def likeness(a: Column, b: Column) -> Column:
    """Share of the tuples that two fingerprints have in common, 0 to 1; two empty ones: 1."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / most)


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.hex(x))), "-")


def _slice_of(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at most ``value``; null is in slice 0.

    Looked up in two steps, first among every ``stride``-th cut, then in the stretch that
    follows it, so a row is compared with about 2 * sqrt(cuts) of them.
    """
    if not cuts:
        return F.lit(0)
    stride = max(1, math.isqrt(len(cuts)))

    def up_to(listed: Column) -> Column:
        return F.coalesce(F.size(F.filter(listed, lambda c: c <= value)), F.lit(0))

    every = F.lit(cuts).cast("array<bigint>")
    before = F.greatest(up_to(F.lit(cuts[::stride]).cast("array<bigint>")) - 1, F.lit(0)) * stride
    return before + up_to(F.slice(every, before + 1, F.lit(stride)))


def with_next(docs: DataFrame, slices: int) -> DataFrame:
    """doc_id, text, slice, nth, and the text of the next document by id, then by text.

    After the last document comes the first. Documents are dealt to slices of the id's
    range, cut at quantiles of the ids (``slices`` numbers on the driver); only inside a
    slice are they sorted in one task. Nulls come first.
    """
    shares = [i / slices for i in range(1, slices)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 10 * slices).alias("c")).first()["c"] if shares else []
    cuts = sorted(set(cuts or []))
    sliced = docs.withColumn("slice", _slice_of(F.col("doc_id"), cuts))
    heads = {r["slice"]: r["head"] for r in sliced.groupBy("slice").agg(
        F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("head")).collect()}
    order = sorted(heads)
    following = {s: order[(i + 1) % len(order)] for i, s in enumerate(order)}
    rows = [(s, heads[following[s]]["known"], heads[following[s]]["doc_id"]) for s in order]
    spark = docs.sparkSession
    next_heads = spark.createDataFrame(rows, "tail_slice int, known boolean, head_id bigint")
    wanted = [h["doc_id"] for h in heads.values() if h["known"]]
    first_texts = stored(
        docs.where(F.col("doc_id").isin(wanted) | F.col("doc_id").isNull())
        .groupBy(F.col("doc_id").alias("of_id")).agg(F.min("text").alias("head_text")),
        "slice-heads",
    )
    tails = next_heads.join(first_texts, F.col("head_id").eqNullSafe(F.col("of_id"))).select("tail_slice", "head_text")
    in_slice = Window.partitionBy("slice").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    ahead = sliced.withColumns({"nth": F.row_number().over(in_slice), "inner_text": F.lead("text").over(in_slice)})
    # Rows that are not the last of their slice have no partner; they are spread.
    last = F.when(F.col("inner_text").isNull(), F.col("slice")).otherwise(
        -1 - F.pmod(F.xxhash64("slice", "nth"), F.lit(SPREAD)).cast("int"))
    head_bytes = first_texts.agg(F.sum(F.octet_length("head_text"))).first()[0] or 0
    return (
        ahead.join(F.broadcast(tails) if head_bytes <= BROADCAST_BYTES else tails, last == F.col("tail_slice"), "left")
        .withColumn("next_text", F.coalesce("inner_text", "head_text"))
        .select("doc_id", "text", "slice", "nth", "next_text", F.col("inner_text").isNull().alias("is_last"))
    )


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text: doc_id, fingerprint (array of long).

    Null and empty texts have the empty fingerprint; equal texts have equal ones.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return sketch(texts, {"fingerprint": "text"})


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text has its last floor(n / 2) code points replaced by the first as many
    (or all) of the next document. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. Null texts count as empty; repeated ids
    follow each other by text; a table of one document is followed by itself; the empty
    table gives no rows. Ids are whole numbers, null first.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pairs = with_next(texts, 4 * partitions(docs))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    prepared = pairs.select(
        "doc_id", "slice", "nth", n.cast("long").alias("n_chars"), "text", edited.alias("edited"),
        F.when(F.col("is_last"), F.col("next_text")).alias("tail_text"),
    ).withColumn("edited_sha256", F.sha2("edited", 256))
    sketched = sketch(prepared, {"own": "text", "edit": "edited", "tail": "tail_text"})
    following = F.coalesce(F.lead("own").over(Window.partitionBy("slice").orderBy("nth")), F.col("tail"))
    return sketched.withColumn("following", following).select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edit")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
