"""Removal of repeated passages by Rabin-Karp hashes of every word window.

Every window of ``size`` words is hashed (64 bits, plus a second hash that deals it to a
partition, so the bits that decide grow with the cluster). Hashes travel in packed form,
one block per partition and piece of a batch: windows that repeat inside the piece are sent
once, which folds passages that many documents share before the shuffle. Each partition
finds the first occurrence of every hash and sends back, per document, which windows are
repeats. Documents then recompute their windows, and the repeated ones merge into maximal
intervals of words to remove.

Order of occurrence: document id (null first), then a hash of the text, then position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import partitions
from riskloom.llm.windows import WORD_BASES, pieces, words_of

BLOCK = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("ties", pa.binary()), ("counts", pa.binary()), ("sent", pa.binary()), ("hashes", pa.binary())])
REPLY = pa.schema([("deal", pa.int32()), ("ids", pa.binary()), ("ties", pa.binary()), ("buckets", pa.binary()), ("counts", pa.binary()), ("nth", pa.binary())])
SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
RESULT = ["n_words", "n_removed", "text", "removed"]
NULL_ID = np.iinfo(np.int64).min  # sorts first


def _by_bucket(found, size: int, buckets: int):
    """Windows ordered by (bucket, text, position): order, text, bucket, hash, first word."""
    at, hashes = found.window_hashes(size, WORD_BASES[0])
    _, dealing = found.window_hashes(size, WORD_BASES[1])
    bucket = (dealing % np.uint64(buckets)).astype(np.int32)
    text = found.text[at]
    order = np.argsort(bucket, kind="stable")  # windows come by text and position
    return at[order], text[order], bucket[order], hashes[order]


def _firsts(hashes: np.ndarray) -> np.ndarray:
    """Number of the first element with the same hash, for every element."""
    order = np.argsort(hashes)
    in_order = hashes[order]
    new = np.r_[True, in_order[1:] != in_order[:-1]]
    groups = np.flatnonzero(new)
    lowest = np.minimum.reduceat(order, groups)
    first = np.empty(len(hashes), np.int64)
    first[order] = lowest[np.cumsum(new) - 1]
    return first


def _send(size: int, buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = (np.asarray(batch.column(i)) for i in (0, 1))
            # Texts in the order of occurrence; of equal rows one is enough.
            rank = np.lexsort((ties, ids))
            same = np.r_[False, (ids[rank][1:] == ids[rank][:-1]) & (ties[rank][1:] == ties[rank][:-1])]
            rank = rank[~same]
            texts = batch.column(2)
            if len(rank) < len(texts) or (rank[1:] < rank[:-1]).any():
                texts = texts.take(pa.array(rank))
            ids, ties = ids[rank], ties[rank]
            for a, b, data, offsets in pieces(texts):
                _, text, bucket, hashes = _by_bucket(words_of(data, offsets), size, buckets)
                if not len(text):
                    continue
                first = _firsts(hashes)
                sent = first == np.arange(len(first))
                # Runs of one text in one bucket.
                runs = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (text[1:] != text[:-1])])
                counts = np.diff(np.r_[runs, len(text)]).astype(np.uint32)
                run_ids, run_ties, run_bucket = ids[a:b][text[runs]], ties[a:b][text[runs]], bucket[runs]
                columns: list[list] = [[] for _ in BLOCK]
                for k in np.unique(run_bucket):
                    r0, r1 = np.searchsorted(run_bucket, [k, k + 1])
                    w0, w1 = runs[r0], (runs[r1] if r1 < len(runs) else len(text))
                    keep = sent[w0:w1]
                    for column, value in zip(columns, (
                        int(k), run_ids[r0:r1].tobytes(), run_ties[r0:r1].tobytes(), counts[r0:r1].tobytes(),
                        np.packbits(keep).tobytes(), hashes[w0:w1][keep].tobytes(),
                    ), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, BLOCK, strict=True)], schema=BLOCK)

    return send


def _find(buckets: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Repeated windows among all blocks of a partition: per text, their numbers in the bucket."""
        yield from _answers(batches, buckets)

    return find


def _answers(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    ids, ties, counts, sent, hashes, bucket = [], [], [], [], [], []
    for batch in batches:
        for row in range(batch.num_rows):
            block = [batch.column(i)[row].as_buffer() for i in range(1, 6)]
            ids.append(np.frombuffer(block[0], np.int64))
            ties.append(np.frombuffer(block[1], np.int64))
            counts.append(np.frombuffer(block[2], np.uint32))
            sent.append(np.unpackbits(np.frombuffer(block[3], np.uint8), count=int(counts[-1].sum())).astype(bool))
            hashes.append(np.frombuffer(block[4], np.uint64))
            bucket.append(np.full(len(ids[-1]), batch.column(0)[row].as_py(), np.int32))
    if not ids:
        return
    ids, ties, counts, sent, hashes, bucket = map(np.concatenate, (ids, ties, counts, sent, hashes, bucket))
    # Rank of each run's document; runs of the same document share it.
    order = np.lexsort((ties, ids))
    new = np.r_[False, (ids[order][1:] != ids[order][:-1]) | (ties[order][1:] != ties[order][:-1])]
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.cumsum(new)
    run = np.repeat(np.arange(len(counts)), counts)
    run_start = np.cumsum(counts, dtype=np.int64) - counts
    nth = np.arange(len(run)) - run_start[run]
    removed = ~sent
    at = np.flatnonzero(sent)
    # The first occurrence has the lowest (document, number); copies of a row tie with it.
    place = np.lexsort((nth[at], rank[run[at]], hashes))
    in_order = hashes[place]
    new = np.r_[True, in_order[1:] != in_order[:-1]]
    lead = place[np.flatnonzero(new)[np.cumsum(new) - 1]]
    same = (rank[run[at[place]]] == rank[run[at[lead]]]) & (nth[at[place]] == nth[at[lead]])
    removed[at[place[~same]]] = True
    found = np.flatnonzero(removed)
    if not len(found):
        return
    runs = run[found]
    cuts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
    lengths = np.diff(np.r_[cuts, len(found)])
    of = runs[cuts]
    # One packed answer for each partition to which documents are dealt.
    deal = _deal(ids[of], ties[of], buckets)
    order = np.argsort(deal, kind="stable")
    of, lengths, cuts, deal = of[order], lengths[order], cuts[order], deal[order]
    ends = np.cumsum(lengths)
    numbers = nth[found[np.repeat(cuts - (ends - lengths), lengths) + np.arange(len(found))]].astype(np.int32)
    edges = np.flatnonzero(np.r_[True, deal[1:] != deal[:-1], True])
    columns: list[list] = [[] for _ in REPLY]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = of[a:b]
        for column, value in zip(columns, (
            int(deal[a]), ids[part].tobytes(), ties[part].tobytes(), bucket[part].tobytes(),
            lengths[a:b].astype(np.int32).tobytes(), numbers[ends[a] - lengths[a] : ends[b - 1]].tobytes(),
        ), strict=True):
            column.append(value)
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, REPLY, strict=True)], schema=REPLY)


def _deal(ids: np.ndarray, ties: np.ndarray, buckets: int) -> np.ndarray:
    """Partition of a document: copies differ in their ids, so they are spread."""
    return np.mod(ids ^ ties, buckets).astype(np.int32)


class _Answers:
    """Answers for the documents of one partition, looked up by (id, tie)."""

    def __init__(self, rows: list[list[bytes]]):
        def joined(i: int, kind) -> np.ndarray:
            return np.concatenate([np.frombuffer(r[i], kind) for r in rows]) if rows else np.zeros(0, kind)

        ids, ties, self.bucket, self.count, self.nth = (joined(i, k) for i, k in enumerate((np.int64, np.int64, np.int32, np.int32, np.int32)))
        self.end = np.cumsum(self.count, dtype=np.int64)
        self.runs: dict[tuple[int, int], list[int]] = {}
        for n, key in enumerate(zip(ids.tolist(), ties.tolist(), strict=True)):
            self.runs.setdefault(key, []).append(n)

    def of(self, keys: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, bucket, number in the bucket) of the repeated windows of a run of texts."""
        text, runs = [], []
        for n, key in enumerate(keys):
            own = self.runs.get(key, ())
            runs += own
            text += [n] * len(own)
        runs, text = np.array(runs, np.int64), np.array(text, np.int64)
        lengths = self.count[runs].astype(np.int64)
        ends = np.cumsum(lengths)
        at = np.repeat(self.end[runs] - ends, lengths) + np.arange(int(lengths.sum()))
        return np.repeat(text, lengths), np.repeat(self.bucket[runs], lengths), self.nth[at]


def _remove(size: int, buckets: int):
    """Answers of the partition first, then its documents.

    Columns: is_text, id_key, tie, text, the answer's five, then columns to carry along.
    """
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list[bytes]] = []
        answers = None
        for batch in batches:
            n_answers = batch.num_rows - int(np.asarray(batch.column(0)).sum())
            rows += [[batch.column(c)[r].as_py() for c in range(4, 9)] for r in range(n_answers)]
            batch = batch.slice(n_answers)
            if not batch.num_rows:
                continue
            if answers is None:
                answers = _Answers(rows)
            keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for a, b, data, offsets in pieces(batch.column(3)):
                part = batch.slice(a, b - a)
                carried = [part.column(i) for i in range(9, part.num_columns)]
                result = _kept(answers.of(keys[a:b]), data, offsets, size, buckets)
                yield pa.RecordBatch.from_arrays([*result, *carried], [*RESULT, *batch.schema.names[9:]])

    return remove


def _kept(repeats: tuple, data, offsets, size: int, buckets: int) -> list[pa.Array]:
    found = words_of(data, offsets)
    n_texts, n_words = len(offsets) - 1, len(found.starts)
    gone = np.zeros(n_words + 1, np.int64)
    text, bucket, nth = repeats
    if len(text):
        at, w_text, w_bucket, _ = _by_bucket(found, size, buckets)
        keys = w_bucket.astype(np.int64) * n_texts + w_text
        first = at[np.searchsorted(keys, bucket.astype(np.int64) * n_texts + text) + nth]
        np.add.at(gone, first, 1)
        np.add.at(gone, first + size, -1)
    removed = np.cumsum(gone[:-1]) > 0
    kept = ~removed
    # Bytes of kept words, and before all but the first of a text one byte for a space.
    edges = np.zeros(len(data) + 1, np.int8)
    edges[found.starts[kept]] += 1
    np.add.at(edges, found.ends[kept], -1)
    keep = np.cumsum(edges[:-1], dtype=np.int8) > 0
    words = np.flatnonzero(kept)
    later = words[np.r_[False, found.text[words][1:] == found.text[words][:-1]]] if len(words) else words
    out = data.copy()
    out[found.starts[later] - 1] = 0x20
    keep[found.starts[later] - 1] = True
    total = np.r_[0, np.cumsum(keep)][offsets]
    texts = pa.StringArray.from_buffers(n_texts, pa.py_buffer(total.astype(np.int32)), pa.py_buffer(out[keep]))
    count = np.diff(found.first)
    running = np.r_[0, np.cumsum(removed)]
    # Maximal intervals, in words of the text.
    opens = np.flatnonzero(removed & np.r_[True, ~removed[:-1] | (found.text[1:] != found.text[:-1])]) if n_words else np.zeros(0, np.int64)
    closes = np.flatnonzero(removed & np.r_[~removed[1:] | (found.text[1:] != found.text[:-1]), True]) + 1 if n_words else opens
    base = found.first[found.text[opens]]
    spans = pa.StructArray.from_arrays([pa.array((opens - base).astype(np.int32)), pa.array((closes - base).astype(np.int32))], fields=list(SPAN))
    per_text = np.searchsorted(found.text[opens], np.arange(n_texts + 1)).astype(np.int32)
    return [
        pa.array(count), pa.array(running[found.first[1:]] - running[found.first[:-1]]), texts,
        pa.ListArray.from_arrays(pa.array(per_text), spans),
    ]


def remove_repeats(
    docs: DataFrame, size: int = 20, id_col: str = "doc_id", text_col: str = "text", with_columns: list[str] | None = None
) -> DataFrame:
    """Every text without the words that a repeated window covers.

    Returns doc_id, n_words, n_removed, text (kept words joined by one space) and removed
    (maximal intervals of word numbers, end exclusive), one row per row of ``docs``. A
    window is repeated if its words also start earlier, as judged on the input. Null and
    empty texts have no words; texts of fewer than ``size`` words lose none. Rows equal in
    id and text are one document: they do not repeat each other and get the same result.
    With ``with_columns`` a struct ``carried`` brings these columns and the ``original``
    text along. The empty table gives no rows.
    """
    buckets = partitions(docs)
    keys = {
        "id_key": F.coalesce(F.col(id_col).cast("long"), F.lit(int(NULL_ID))),
        "tie": F.xxhash64(text_col),
    }
    blocks = docs.select(*[c.alias(n) for n, c in keys.items()], F.col(text_col).alias("text")).mapInArrow(
        _send(size, buckets), "bucket int, ids binary, ties binary, counts binary, sent binary, hashes binary"
    )
    packed = "ids binary, ties binary, buckets binary, counts binary, nth binary"
    answers = blocks.repartitionById(buckets, F.col("bucket")).mapInArrow(_find(buckets), f"deal int, {packed}")
    carried = {"doc_id": F.col(id_col)}
    if with_columns is not None:
        carried["original"] = F.col(text_col)
        carried |= {c: F.col(f"`{c}`") for c in with_columns}
    # Carried columns travel under numbers, so no name can clash.
    numbered = {f"c{i}": c for i, c in enumerate(carried.values())}
    texts = docs.select(*[c.alias(n) for n, c in (keys | {"text": F.col(text_col)} | numbered).items()]).withColumns({
        "deal": F.pmod(F.col("id_key").bitwiseXOR(F.col("tie")), F.lit(buckets)).cast("int"), "is_text": F.lit(True),
    })
    both = texts.unionByName(answers.withColumn("is_text", F.lit(False)), allowMissingColumns=True)
    dealt = both.repartitionById(buckets, F.col("deal")).sortWithinPartitions("is_text").select(
        "is_text", "id_key", "tie", "text", "ids", "ties", "buckets", "counts", "nth", *numbered
    )
    kinds = "".join(f", {n} {dealt.schema[n].dataType.simpleString()}" for n in numbered)
    out = dealt.mapInArrow(
        _remove(size, buckets), "n_words long, n_removed long, text string, removed array<struct<start:int,end:int>>" + kinds
    )
    result = ["c0 AS doc_id", *RESULT]
    if with_columns is not None:
        fields = ", ".join(f"'{name.replace("'", "\\'")}', {n}" for n, name in zip(list(numbered)[1:], list(carried)[1:], strict=True))
        result.append(f"named_struct({fields}) AS carried")
    return out.selectExpr(*result)


def deduplicated(docs: DataFrame, size: int = 20) -> DataFrame:
    """``docs`` (doc_id, text and any others) with repeated passages removed.

    Same columns; where words were removed the text is the kept words joined by one space,
    and ``n_chars`` follows. Texts that nothing was taken from stay as they are. Documents
    of which no word is left are dropped.
    """
    kept = remove_repeats(docs, size, with_columns=[c for c in docs.columns if c not in ("doc_id", "text", "n_chars")])
    changed = F.col("n_removed") > 0
    values = {"text": F.when(changed, F.col("text")).otherwise(F.col("carried")["original"])}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.length(values["text"]).cast(docs.schema["n_chars"].dataType)
    return kept.where("n_words > n_removed").select(*[
        F.col("doc_id") if c == "doc_id" else values[c].alias(c) if c in values else F.col("carried")[c].alias(c) for c in docs.columns
    ])
