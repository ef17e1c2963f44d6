"""Jaccard join on word n-grams with Bayesian pruning of candidates.

1. Texts with the same words are one class (MD5 of the words).
2. ``BANDS`` bands of ``ROWS`` MinHash values propose neighbours: classes that share a band
   are linked to the band's least class, a star, never all pairs. A pair at the threshold
   shares no band with probability (1 - 0.8 ** 5) ** 30 = 7e-6.
3. Components of the stars bound where links can be. A component is dealt to blocks of
   about ``BLOCK`` classes, every pair of blocks is a unit of work, so a group of any size
   is spread over tasks and every pair is looked at once.
4. In a unit, MinHash values are compared 16 at a time. With m of k values equal, the
   similarity has the posterior Beta(m + 1, k - m + 1); a pair goes when the probability
   that it reaches the threshold is below ``TOLERANCE``. What is left after 64 values is
   verified exactly on the n-gram sets.
5. Units return, per class, the number of linked documents and a spanning forest of the
   links, never the pairs; components of the forests are the classes of the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import partitions, same_words_key, stored
from riskloom.llm.components import components
from riskloom.llm.windows import WORD_BASES, mixed, pieces, ranges_hash, words_of

BANDS, ROWS = 30, 5
STEP, STEPS = 16, 4
TOLERANCE = 1e-9
BLOCK = 1024
DENSE = 1_000_000  # pairs compared at once
UNIT_ROWS = 512

_random = np.random.default_rng(20240229)
FACTORS = (_random.integers(0, 2**32, BANDS * ROWS + STEP * STEPS, np.uint64) | np.uint64(1)).astype(np.uint32)
SHIFTS = _random.integers(0, 2**32, BANDS * ROWS + STEP * STEPS, np.uint64).astype(np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of a run of texts, and where each text's begin.

    A text of fewer than ``size`` words is one shorter n-gram; one without words has none.
    """
    found = words_of(data, offsets)
    at, hashes = found.window_hashes(size, WORD_BASES[0])
    count = np.diff(found.first)
    short = np.flatnonzero((count > 0) & (count < size))
    text = np.r_[found.text[at], short]
    whole = ranges_hash(found.hashes, WORD_BASES[0], found.first[short], found.first[short + 1])
    hashes = np.r_[hashes, mixed(whole + count[short].astype(np.uint64))]
    order = np.argsort(text, kind="stable")
    return hashes[order], np.searchsorted(text[order], np.arange(len(offsets)))


def minhashes(hashes: np.ndarray, first: np.ndarray, functions: range) -> np.ndarray:
    """Texts x functions; texts without n-grams have zeros."""
    small = (hashes >> np.uint64(32)).astype(np.uint32)
    some = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, len(functions)), np.uint32)
    if len(some):
        for column, f in enumerate(functions):
            out[some, column] = np.minimum.reduceat(small * FACTORS[f] + SHIFTS[f], first[some])
    return out


def _bands(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("n_grams", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(2)):
                hashes, first = shingles(data, offsets, size)
                values = minhashes(hashes, first, range(BANDS * ROWS)).astype(np.uint64)
                folded = np.zeros((b - a, BANDS), np.uint64)
                for r in range(ROWS):
                    folded = mixed(folded ^ values[:, r::ROWS]) + np.uint64(r)
                folded = mixed(folded + np.arange(BANDS, dtype=np.uint64))
                counts = np.diff(first)
                lists = pa.ListArray.from_arrays(
                    np.arange(0, BANDS * (b - a) + 1, BANDS, dtype=np.int32), pa.array(folded.ravel().view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a).cast(pa.string()), pa.array(counts), lists], schema=schema
                )

    return sign


def least_matches(threshold: float, compared: int, tolerance: float = TOLERANCE) -> int:
    """Fewest equal values of ``compared`` with which a pair stays a candidate.

    P(Beta(m + 1, k - m + 1) >= t) = P(Binomial(k + 1, t) <= m).
    """
    below = 0.0
    for m in range(compared + 1):
        below += math.comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        if below >= tolerance:
            return m
    return compared


def candidate_pairs(left: np.ndarray, right: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of left, row of right) that survive the pruning; i < j if right is None."""
    bounds = [least_matches(threshold, STEP * (s + 1)) for s in range(STEPS)]
    other = left if right is None else right
    rows = max(1, DENSE // max(1, len(other)))
    found = []
    for a in range(0, len(left), rows):
        part = left[a : a + rows]
        equal = np.zeros((len(part), len(other)), np.uint8)
        for c in range(STEP):
            equal += part[:, c, None] == other[None, :, c]
        i, j = np.nonzero(equal >= bounds[0])
        score = equal[i, j].astype(np.int64)
        i = i + a
        if right is None:
            keep = i < j
            i, j, score = i[keep], j[keep], score[keep]
        for s in range(1, STEPS):
            columns = slice(STEP * s, STEP * (s + 1))
            score = score + (left[i, columns] == other[j, columns]).sum(1)
            keep = score >= bounds[s]
            i, j, score = i[keep], j[keep], score[keep]
        found.append((i, j))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sorted n-gram sets reach the threshold, exactly.

    Many pairs among few sets are counted by products of incidence matrices, slice by
    slice of the n-grams; the results are the same.
    """
    sizes = np.array([len(s) for s in sets])
    if len(i) <= 8 * len(sets):
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    else:
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, gram, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = seen[gram] > 1
        owner, gram = owner[shared], np.unique(gram[shared], return_inverse=True)[1]
        order = np.argsort(gram, kind="stable")
        owner, gram = owner[order], gram[order]
        width = max(256, 8_000_000 // len(sets))
        counts = np.zeros((len(sets), len(sets)), np.float32)
        for start in range(0, int(gram[-1]) + 1 if len(gram) else 0, width):
            lo, hi = np.searchsorted(gram, [start, start + width])
            dense = np.zeros((len(sets), width), np.float32)
            dense[owner[lo:hi], gram[lo:hi] - start] = 1
            counts += dense @ dense.T
        both = counts[i, j].astype(np.int64)
    return both / np.maximum(1, sizes[i] + sizes[j] - both) >= threshold


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


UNIT = pa.schema([("key", pa.string()), ("links", pa.int64()), ("root", pa.string())])


def _unit(table: pa.Table, hashes: list[np.ndarray], signature: np.ndarray, threshold: float) -> list[tuple]:
    """Links inside one block or between two: (class, linked documents, root class)."""
    keys = table["key"].to_pylist()
    rows = list({k: n for n, k in enumerate(keys)}.values())  # a row that is there twice counts once
    if len(rows) < 2:
        return []
    block, copies = (np.asarray(table[c])[rows] for c in ("block", "copies"))
    low, high = table["low"][0].as_py(), table["high"][0].as_py()
    mins = signature[rows]
    if low == high:
        i, j = candidate_pairs(mins, None, threshold)
    else:
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        if not len(left) or not len(right):
            return []
        i, j = candidate_pairs(mins[left], mins[right], threshold)
        i, j = left[i], right[j]
    if not len(i):
        return []
    sets = [np.unique(hashes[r]) for r in rows]
    keep = verified(sets, i, j, threshold)
    i, j = i[keep], j[keep]
    links = np.zeros(len(rows), np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    root = _roots(len(rows), i, j)
    return [(keys[rows[n]], int(links[n]), keys[rows[root[n]]]) for n in np.flatnonzero(links)]


def _units(size: int, threshold: float):
    """Units of a sorted partition, one after the other; a unit may span batches."""

    def work(table: pa.Table) -> pa.RecordBatch:
        hashes, signatures = [], []
        for _, _, data, offsets in pieces(table["text"].combine_chunks()):
            values, first = shingles(data, offsets, size)
            signatures.append(minhashes(values, first, range(BANDS * ROWS, BANDS * ROWS + STEP * STEPS)))
            hashes += [values[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        signature = np.concatenate(signatures)
        out = []
        for a, b in _cuts(table):
            out += _unit(table.slice(a, b - a), hashes[a:b], signature[a:b], threshold)
        columns = zip(*out, strict=True) if out else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, UNIT, strict=True)], schema=UNIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            table = pa.Table.from_batches(waiting)
            start = 0
            for a, _ in _cuts(table):  # the last unit may go on in the next batch
                if a - start >= UNIT_ROWS:
                    yield work(table.slice(start, a - start))
                    start = a
            waiting = table.slice(start).to_batches()
        if waiting:
            yield work(pa.Table.from_batches(waiting))

    return run


def _cuts(table: pa.Table) -> list[tuple[int, int]]:
    unit = [np.asarray(table[c].combine_chunks()) for c in ("group", "low", "high")]
    new = np.flatnonzero(np.any([u[1:] != u[:-1] for u in unit], axis=0)) + 1
    edges = [0, *new.tolist(), table.num_rows]
    return list(zip(edges[:-1], edges[1:], strict=True))


def linked_classes(docs: DataFrame, size: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """Stored table of (doc_id, key, n_grams, copies, links, group), one row per document.

    ``key`` names the class of texts with the same words, ``links`` is the number of
    documents of other classes that are similar, ``group`` the component's least key.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), same_words_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    signed = stored(texts.mapInArrow(_bands(size), "doc_id long, key string, n_grams long, bands array<long>"), "bands")
    classes = stored(
        signed.where("n_grams > 0").groupBy("key")
        .agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"))
        .withColumn("node", F.xxhash64("key")), "classes",
    )
    proposed = classes.select("node", F.explode("bands").alias("band"))
    hubs = proposed.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("other")).where("hub <> other")
    stars = proposed.join(hubs.select("band", "hub"), "band").where("node <> hub")
    groups = stored(components(stars, "node", "hub"), "candidate-groups")
    blocks = groups.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = (
        classes.drop("bands").join(groups, "node").join(blocks, "root")
        .withColumn("block", F.pmod(F.xxhash64("key", F.lit(7)), F.col("blocks")).cast("int"))
        .select(F.col("root").alias("group"), F.col("key").alias("own_key"), "first_id", "copies", "block", "blocks")
    )
    spread = (
        texts.join(members, (F.col("key") == F.col("own_key")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("group", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "key", "copies", "text")
    )
    units = spread.repartition(partitions(docs), "group", "low", "high").sortWithinPartitions("group", "low", "high")
    found = stored(units.mapInArrow(_units(size, threshold), "key string, links long, root string"), "links")
    joined = components(found, "key", "root")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    known = (
        classes.select("key", "copies").join(links, "key", "left")
        .join(joined.withColumnsRenamed({"node": "key", "root": "group"}), "key", "left")
        .select("key", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group", "key").alias("group"))
    )
    return stored(signed.drop("bands").join(known, "key", "left"), "linked")


def join(docs: DataFrame, size: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate classes: doc_id, class_id, n_links, n_copies.

    Two documents are linked if the Jaccard similarity of their sets of ``size``-word
    n-grams is at least ``threshold``; copies are linked too. ``class_id`` is the least
    doc_id that links lead to, ``n_links`` the number of documents linked directly,
    ``n_copies`` of those the ones with the same words. A text of fewer words is one
    n-gram; null and empty texts have none and are linked to nothing: they are classes of
    their own. Documents without an id are linked like others; a class has no id only if
    none of its documents has one. Repeated rows are copies. The empty table gives no rows.
    """
    linked = linked_classes(docs, size, threshold, id_col, text_col)
    named = linked.where("group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("class_id"))
    return linked.join(named, "group", "left").select(
        "doc_id",
        F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.coalesce(F.col("copies") - 1, F.lit(0)).alias("n_copies"),
    )


def one_of_each(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` (doc_id, text and any others) with one document of each class.

    The least doc_id stays, a null id only where the class has no other; of repeated rows
    with that id and the same words one stays. Texts without words all stay. No rows give
    no rows; other columns may have any names.
    """
    linked = linked_classes(docs, size, threshold, "doc_id", "text")
    chosen = (
        linked.where("group IS NOT NULL").groupBy("group")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")).alias("c"))
        .select(F.col("c.doc_id").alias("chosen_id"), F.col("c.key").alias("chosen_key"))
    )
    keyed = docs.select(same_words_key(F.col("text")).alias("words_key"), F.col("doc_id").alias("id"), F.struct(*docs.columns).alias("row"))
    wordless = F.md5(F.lit(""))
    kept = keyed.where(F.col("words_key") != wordless).join(
        chosen, (F.col("words_key") == F.col("chosen_key")) & F.col("id").eqNullSafe(F.col("chosen_id"))
    )
    nth = F.row_number().over(Window.partitionBy("words_key", "id").orderBy(F.lit(0)))
    single = kept.select("row", nth.alias("nth_same")).where("nth_same = 1").select("row.*")
    return single.unionByName(keyed.where(F.col("words_key") == wordless).select("row.*"))
