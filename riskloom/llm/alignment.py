"""Alignment of two tokenizers over a corpus, counted by external spilling.

Both encodings of a text end tokens at byte offsets; offsets where both end cut the tokens
into groups, and the two tokens that end there are a link. How often an id pair is linked
is counted over all documents without holding pairs in memory:

1. Documents are encoded in chunks of bounded size. A chunk's (B id, A id, document, times)
   records are sorted side-major, radix-partitioned by the B id's upper digits into cells, and written as
   zstd-compressed runs. Chunk and place in the chunk name a document from here on.
2. A cell whose runs exceed a bound is split over several tasks by chunk, as a B id may hold
   a large part of all links. A task merges its runs with a heap, block by block. Partial
   counts of split cells are added up first: one row per pair and task.
3. In side-major order all pairs of a B id follow each other, so its highest count is known
   when its last pair is; the documents' contributions are then packed per chunk and sent
   back there.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import tokenizing
from riskloom.llm.common import stored

CHUNK_CHARS = 2_000_000
DOC_BITS = 14  # documents of a chunk
CELLS = 256
CELL_BYTES = 8 << 20  # compressed runs of one merge task
BLOCK = 4_096  # records of a run that are decompressed at once
REMEMBERED = 600_000  # units

ENCODED = pa.schema([
    ("chunk", pa.int64()), ("cell", pa.int32()), ("run", pa.binary()),
    ("place", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()),
])
ENCODED_DDL = (
    "chunk long, cell int, run binary, place long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
)
PAIRS = pa.schema([("cell", pa.int32()), ("pair", pa.int64()), ("n", pa.int64())])
SENT = pa.schema([("to_chunk", pa.int64()), ("sent", pa.binary())])
RESULT = pa.schema([(f.name, f.type) for f in list(ENCODED)[4:]] + [("n_best", pa.int64()), ("count_sum", pa.int64())])


def write_run(keys: np.ndarray, times: np.ndarray) -> bytes:
    """A sorted run: blocks of key steps and times."""
    blocks = []
    for at in range(0, len(keys), BLOCK):
        k = keys[at : at + BLOCK]
        blocks.append(tokenizing.packed(np.diff(k, prepend=0), times[at : at + BLOCK]))
    return b"".join(blocks)


def read_run(run: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    at = 0
    while at < len(run):
        (steps, times), at = tokenizing.unpacked(run, at, 2)
        yield np.cumsum(steps), times


class UnitPairs:
    """What each unit of text gives: its groups as text, tokens on either side, linked pairs.

    ``number`` maps units to rows of the other members. A unit that the tokens do not
    spell has ``bad`` set and nothing else.
    """

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = tokenizing.load(path_a, True), tokenizing.load(path_b, True)
        self.bytes_a, self.bytes_b = self.a.token_bytes(), self.b.token_bytes()
        self.length_a, self.length_b = (np.array([len(t) for t in x]) for x in (self.bytes_a, self.bytes_b))
        self.size_a = len(self.bytes_a)
        if len(self.bytes_b) * self.size_a >> (62 - DOC_BITS):
            raise ValueError("the vocabularies are too large for the keys of pairs")
        # A cell is a range of B ids.
        self.cell_starts = np.arange(CELLS + 1) * -(-len(self.bytes_b) // CELLS) * self.size_a
        # Ids as text with what follows them: another of the side, the other side; another, the next group.
        self.texts = np.array(
            [f"{i}{c}" for c in ",|" for i in range(self.size_a)] + [f"{i}{c}" for c in ",;" for i in range(len(self.bytes_b))], object
        )
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.n_a, self.n_b, self.bad = (np.zeros(0, np.int64) for _ in range(3))
        self.pair_ends, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def spelled(self, ids_a: list[int], ids_b: list[int], text: str) -> bool:
        return b"".join([self.bytes_a[i] for i in ids_a]) == b"".join([self.bytes_b[i] for i in ids_b]) == text.encode()

    def learn(self, units: list[str]) -> None:
        """Encode and align new units: regular ones many at once, others one by one."""
        many = [u for u in units if tokenizing.REGULAR.fullmatch(u)]
        rows = tokenizing.rows_of_units(many)
        rows_a, rows_b = self.a.ids(rows), self.b.ids(rows)
        single = set(units).difference(many)
        if not all(map(self.spelled, rows_a, rows_b, rows)):
            single, rows_a, rows_b, many = units, [], [], []
        self.add(many, [i for r in rows_a for i in r], [i for r in rows_b for i in r])
        single = list(single)
        ids = list(zip(single, self.a.ids(single), self.b.ids(single), strict=True))
        good = [(u, a, b) for u, a, b in ids if self.spelled(a, b, u)]
        self.add([u for u, _, _ in good], [i for _, a, _ in good for i in a], [i for _, _, b in good for i in b])
        self.add_bad([u for u in single if u not in self.number])

    def add(self, units: list[str], ids_a: list[int], ids_b: list[int]) -> None:
        """Units that both sides spell, with the tokens of all of them on either side."""
        if not units:
            return
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        _, cut_a, cut_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        unit_end = np.cumsum([len(u.encode()) for u in units])
        upto_a, upto_b, upto_group = (np.searchsorted(ends, unit_end, "right") for ends in (end_a, end_b, end_a[cut_a]))
        # In the text of groups, a token's place is after all of its side and all of the other side's earlier groups.
        text = np.empty(len(a) + len(b), np.int64)
        group_a, group_b = np.searchsorted(cut_a, np.arange(len(a))), np.searchsorted(cut_b, np.arange(len(b)))
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[cut_a], last_b[cut_b] = 1, 1
        text[np.arange(len(a)) + np.r_[0, cut_b + 1][group_a]] = a + last_a * self.size_a
        text[np.arange(len(b)) + (cut_a + 1)[group_b]] = 2 * self.size_a + b + last_b * len(self.bytes_b)
        words, ends = self.texts[text].tolist(), [0, *(upto_a + upto_b).tolist()]
        self.number.update(zip(units, range(len(self.groups), len(self.groups) + len(units)), strict=True))
        self.groups += ["".join(words[i:j]) for i, j in zip(ends, ends[1:], strict=False)]
        self.n_a, self.n_b = np.r_[self.n_a, np.diff(upto_a, prepend=0)], np.r_[self.n_b, np.diff(upto_b, prepend=0)]
        self.bad = np.r_[self.bad, np.zeros(len(units), np.int64)]
        self.pair_ends = np.r_[self.pair_ends, len(self.pairs) + upto_group]
        self.pairs = np.r_[self.pairs, b[cut_b] * self.size_a + a[cut_a]]

    def add_bad(self, units: list[str]) -> None:
        nothing = np.zeros(len(units), np.int64)
        self.number.update(zip(units, range(len(self.groups), len(self.groups) + len(units)), strict=True))
        self.groups += [""] * len(units)
        self.n_a, self.n_b, self.bad = np.r_[self.n_a, nothing], np.r_[self.n_b, nothing], np.r_[self.bad, nothing + 1]
        self.pair_ends = np.r_[self.pair_ends, nothing + len(self.pairs)]


def encode(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of documents (``cell`` null) and runs of pair-document records, by chunk."""

    def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = UnitPairs(path_a, path_b)
        task = TaskContext.get().partitionId() << 32
        for at, chunk in enumerate(tokenizing.chunks(rows_of(batches), 1, CHUNK_CHARS, 1 << DOC_BITS)):
            if len(known.groups) > REMEMBERED:
                known.clear()
            texts = [tokenizing.units(" " + text) if text else [] for _, text in chunk]
            new = set().union(*texts).difference(known.number)
            if new:
                known.learn(list(new))
            used = [n for found in texts for n in map(known.number.__getitem__, found)]
            ends = list(itertools.accumulate(map(len, texts), initial=0))
            del texts, new
            unit = np.array(used, np.int64)
            per_doc = lambda x: np.diff(np.r_[0, np.cumsum(x)][ends])  # noqa: B023, E731
            good = (np.diff(ends) > 0) & (per_doc(known.bad[unit]) == 0)
            n_links = known.pair_ends[unit + 1] - known.pair_ends[unit]
            counts = [np.where(good, per_doc(x), 0) for x in (known.n_a[unit], known.n_b[unit], n_links)]
            digests = [
                hashlib.sha256("".join(map(known.groups.__getitem__, used[i:j]))[:-1].encode()).hexdigest() if ok else ""
                for i, j, ok in zip(ends, ends[1:], good.tolist(), strict=False)
            ]
            n = len(chunk)
            columns = [[task + at] * n, [None] * n, [None] * n, range(n), [doc for doc, _ in chunk], *counts, counts[2], digests]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ENCODED, strict=True)], schema=ENCODED)
            place = np.repeat(np.arange(n), np.diff(ends))
            unit, place = unit[good[place]], place[good[place]]
            if not len(unit):
                continue
            where, owner = tokenizing.expanded(unit, known.pair_ends)
            keys = known.pairs[where] << DOC_BITS | place[owner]
            keys, times = np.unique(keys, return_counts=True)
            cuts = np.searchsorted(keys, known.cell_starts << DOC_BITS)
            runs = [(c, write_run(keys[i:j], times[i:j])) for c, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
            cells, blobs = zip(*runs, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([task + at] * len(runs)), pa.array(cells, pa.int32()), pa.array(blobs, pa.binary()), *(pa.nulls(len(runs), f.type) for f in list(ENCODED)[3:])],
                schema=ENCODED,
            )

    return docs.mapInArrow(spill, ENCODED_DDL)


def merged(runs: list[bytes], size_a: int) -> Iterator[tuple[np.ndarray, ...]]:
    """K-way merge of runs: (pair, run, place, times) with every B id whole in one batch.

    Two heaps: the B id that each run's held records start with, and the one they end with.
    What lies below the least end is complete, and only runs that start below it are asked.
    """
    blocks = [read_run(r) for r in runs]
    held: list[tuple[np.ndarray, np.ndarray]] = [next(b) for b in blocks]
    side = lambda key: int(key >> DOC_BITS) // size_a
    starts = [(side(k[0]), i) for i, (k, _) in enumerate(held)]
    ends = [(side(k[-1]), i) for i, (k, _) in enumerate(held)]
    heapq.heapify(starts)
    heapq.heapify(ends)
    while starts:
        if ends and starts[0][0] >= ends[0][0]:  # the least end may go on in its run's next block
            _, i = heapq.heappop(ends)
            more = next(blocks[i], None)
            if more is not None:
                if len(held[i][0]) == 0:
                    heapq.heappush(starts, (side(more[0][0]), i))
                held[i] = tuple(np.concatenate(x) for x in zip(held[i], more, strict=True))
                heapq.heappush(ends, (side(more[0][-1]), i))
            continue
        bound = ends[0][0] if ends else None
        taken = []
        while starts and (bound is None or starts[0][0] < bound):
            _, i = heapq.heappop(starts)
            keys, times = held[i]
            cut = len(keys) if bound is None else int(np.searchsorted(keys, (bound * size_a) << DOC_BITS))
            taken.append((i, keys[:cut], times[:cut]))
            held[i] = keys[cut:], times[cut:]
            if cut < len(keys):
                heapq.heappush(starts, (side(keys[cut]), i))
        keys = np.concatenate([k for _, k, _ in taken])
        pair = keys >> DOC_BITS
        order = np.argsort(pair, kind="stable")
        run = np.repeat([i for i, _, _ in taken], [len(k) for _, k, _ in taken])
        times = np.concatenate([t for _, _, t in taken])
        yield pair[order], run[order], (keys & (1 << DOC_BITS) - 1)[order], times[order]


def pair_sums(pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a sorted batch, the sum of each, and the rows' index into them."""
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    which = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(pair)]))
    return pair[first], np.add.reduceat(times, first), which


def count_pairs(split: DataFrame, size_a: int) -> DataFrame:
    """Partial counts of the pairs of split cells, added up: cell, pair, n."""

    def count(key: tuple, table: pa.Table) -> pa.Table:
        found = [pair_sums(pair, times)[:2] for pair, _, _, times in merged(table["run"].to_pylist(), size_a)]
        pairs, n = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(n), pa.int32()), pa.array(pairs), pa.array(n)], schema=PAIRS)

    partial = split.groupBy("cell", "part").applyInArrow(count, "cell int, pair long, n long")
    return partial.groupBy("cell", "pair").agg(F.sum("n").alias("n"))


def send_back(runs: DataFrame, counts: DataFrame, size_a: int) -> DataFrame:
    """What every merge task finds for the documents of a chunk: to_chunk, sent."""

    def contribute(key: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known["pair"].to_numpy(), kind="stable")
        all_pairs, all_counts = known["pair"].to_numpy()[order], known["n"].to_numpy()[order]
        parts = []
        for pair, run, place, times in merged(table["run"].to_pylist(), size_a) if table.num_rows else ():
            pairs, n, which = pair_sums(pair, times)
            side = pairs // size_a
            if len(all_pairs):  # a split cell: other tasks hold records of these pairs, too
                low, high = np.searchsorted(all_pairs, [side[0] * size_a, (side[-1] + 1) * size_a])
                pairs, n = all_pairs[low:high], all_counts[low:high]
                which, side = np.searchsorted(pairs, pair), pairs // size_a
            first = np.flatnonzero(np.r_[True, side[1:] != side[:-1]])
            highest = np.repeat(np.maximum.reduceat(n, first), np.diff(np.r_[first, len(side)]))
            parts.append((run << DOC_BITS | place, times * (n == highest)[which], times * n[which]))
        if not parts:
            return SENT.empty_table()
        doc, best, total = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(doc, kind="stable")
        doc, first = np.unique(doc[order], return_index=True)
        best, total = (np.add.reduceat(x[order], first) for x in (best, total))
        chunk, at = np.unique(doc >> DOC_BITS, return_index=True)
        ends = np.r_[at[1:], len(doc)]
        name = table["chunk"].to_pylist()
        place = doc & (1 << DOC_BITS) - 1
        sent = [tokenizing.packed(place[i:j], best[i:j], total[i:j]) for i, j in zip(at, ends, strict=True)]
        return pa.Table.from_arrays([pa.array([name[c] for c in chunk], pa.int64()), pa.array(sent, pa.binary())], schema=SENT)

    return runs.groupBy("cell", "part").cogroup(counts.groupBy("cell", "part")).applyInArrow(contribute, "to_chunk long, sent binary")


def add_up(docs: pa.Table, sent: pa.Table) -> pa.Table:
    """A chunk's documents with the sums of what was sent back."""
    sums = np.zeros((2, docs.num_rows), np.int64)
    for data in sent["sent"].to_pylist():
        (place, best, total), _ = tokenizing.unpacked(data, 0, 3)
        sums[0, place] += best
        sums[1, place] += total
    docs = docs.sort_by("place")
    return pa.Table.from_arrays([*(docs[n] for n in RESULT.names[:-2]), *map(pa.array, sums)], schema=RESULT)


def align(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", cell_bytes: int = CELL_BYTES
) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum.

    Text with a space before it is encoded by ``path_a`` (byte-level), text by ``path_b``
    (pieces; adds the space itself). A link is a token of A and one of B that end at the
    same byte, so a group holds exactly one. ``n_best`` counts links whose pair is the
    most frequent of its B id, ties included; ``count_sum`` adds up the counts of links'
    pairs. Null and empty texts, and those whose tokens do not spell them (they hold the
    mark that B uses for spaces), have no tokens: zeros and ``''``. Null ids and repeated
    rows are rows of their own; ids are integers. No rows give no rows; other columns
    are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    encoded = stored(encode(texts, path_a, path_b), "token-runs")
    size_a = len(tokenizing.load(path_a, True).token_bytes())
    runs = encoded.where(F.col("cell").isNotNull()).select("chunk", "cell", "run")
    # At most CELLS rows, whatever the input.
    parts = runs.groupBy("cell").agg(F.ceil(F.sum(F.length("run")) / cell_bytes).cast("int").alias("parts"))
    runs = runs.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("chunk"), F.col("parts")).cast("int"))
    counts = count_pairs(runs.where(F.col("parts") > 1), size_a)
    counts = counts.join(F.broadcast(parts), "cell").select("cell", "pair", "n", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    sent = send_back(runs.select("chunk", "cell", "part", "run"), counts, size_a)
    names = encoded.where(F.col("cell").isNull()).select(F.col("chunk").alias("in_chunk"), "place", *RESULT.names[:-2])
    return names.groupBy("in_chunk").cogroup(sent.groupBy("to_chunk")).applyInArrow(
        add_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    )
