"""Vector best-fit packing of tokenised documents into training sequences.

Documents become token ids plus an end token; longer ones are cut into full sequences and
one shorter first piece. A sequence has three capacities: tokens, documents and attention
cost (sum of squared lengths). Pieces are placed in order of falling length into the bin
that fits them best under every constraint: by the residual norm that is left, or by the
weighted dot product of demand and residual. Packing runs in groups of about
``GROUP_PIECES`` pieces; each group wastes at most part of its last bins. Only lengths and
checksums travel to the groups, never token ids; where these are asked for, they are written
with the pieces and joined to the places.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import stored

GROUP_PIECES = 16_384
CACHE_ENTRIES = 600_000
END_ID = 2


class PieceEncoder(dict):
    """Token ids of texts by a byte-level BPE given as ranks, as little-endian 32-bit ids.

    The pre-tokenizer never joins what stands before a single space with what follows it,
    so a text is encoded part by part and the ids of parts are remembered (this dict).
    Texts in which a space touches other white space are encoded whole.
    """

    touching = re.compile(r" \s|\s ")

    def __init__(self, ranks: str, pattern: str, specials: tuple[tuple[str, int], ...] = ()):
        super().__init__()
        self.specials = {text: array("I", [i]).tobytes() for text, i in specials}
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if specials else None
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(t): int(i) for t, i in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def whole(self, text: str) -> bytes:
        return array("I", self.bpe.encode_ordinary(text)).tobytes()

    def __missing__(self, part: str) -> bytes:
        ids = self[part] = self.whole(" " + part)
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text; special strings in it are one id each, as the library takes them."""
        if not self.special or not self.special.search(text):
            return self.between(text)
        found = [self.specials[s] for s in self.special.findall(text)]
        return b"".join(x for pair in zip(map(self.between, self.special.split(text)), [*found, b""], strict=True) for x in pair)

    def between(self, text: str) -> bytes:
        if self.touching.search(text):
            return self.whole(text)
        head, *parts = text.split(" ")
        ids = self.whole(head) + b"".join(map(self.__getitem__, parts))
        if len(self) > CACHE_ENTRIES:
            self.clear()
        return ids


def cut(n_tokens: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first may be shorter."""
    first = n_tokens % most or most
    return [(0, first), *((s, most) for s in range(first, n_tokens, most))]


PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"
IDS = pa.field("ids", pa.binary())
TEXTS_AT_ONCE = 64


def pieces(
    docs: DataFrame, tokenizer: tuple, most: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32.

    ``tokenizer`` is the path of a ranks file, the pre-tokenizer's pattern and the special
    strings with their ids, which are recognised inside texts. Null and
    empty texts are the end token alone. ``with_ids`` adds ``ids``, the bytes that the
    checksum is of: little-endian 32-bit token ids.
    """
    end = np.asarray([end_id], "<u4").tobytes()
    schema = PIECES.append(IDS) if with_ids else PIECES

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(*tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = memoryview(encoder.encode(text or "") + end)
                    for i, (start, n) in enumerate(cut(len(ids) // 4, most)):
                        mine = ids[4 * start : 4 * (start + n)]
                        rows.append((doc, i, start, n, zlib.crc32(mine), *([bytes(mine)] if with_ids else [])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
                )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(tokenise, PIECES_DDL + (", ids binary" if with_ids else ""))


def best_fit(demands: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Bin of every item; items are taken in the order given.

    ``demands`` is items x constraints. Bins that can take no more tokens are set aside.
    """
    n, d = demands.shape
    bins = np.empty(n, np.int64)
    scale = weights / np.maximum(capacity, 1).astype(float) ** 2
    room = np.empty((d, max(n, 1)), np.int64)  # one row per constraint
    label = np.empty(max(n, 1), np.int64)
    n_open = n_bins = 0
    used = [c for c in range(d) if scale[c]]
    for i, need in enumerate(demands):
        fits = room[0, :n_open] >= need[0]
        for c in range(1, d):
            fits &= room[c, :n_open] >= need[c]
        candidates = np.flatnonzero(fits)
        if len(candidates):
            score = np.zeros(len(candidates))
            for c in used:
                free = room[c, candidates]
                score += scale[c] * ((free - need[c]).astype(float) ** 2 if rule == "norm" else -(free.astype(float) * need[c]))
            j = candidates[np.argmin(score)]
        else:
            j = n_open
            room[:, j], label[j] = capacity, n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
        room[:, j] -= need
        bins[i] = label[j]
        if not room[:, j].all():  # some capacity is used up
            n_open -= 1
            room[:, j], label[j] = room[:, n_open], label[n_open]
    return bins, n_bins


def pack(
    cut_pieces: DataFrame, most: int, max_docs: int, max_cost: int,
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0), rule: str = "norm",
) -> DataFrame:
    """Place every piece: adds sequence_id and offset (gapless from 0).

    ``rule`` is ``norm`` (least weighted residual norm) or ``dot`` (greatest weighted dot
    product of demand and residual). No sequence exceeds ``most`` tokens, ``max_docs``
    pieces or ``max_cost`` squared tokens; a piece that alone exceeds a capacity raises.
    Groups go by ``piece_no``, a number fixed in a written table, so repeated rows and null
    ids are spread like others; without that column the pieces are written with one first.
    Where the pieces have ``ids``, these come last in the result.
    """
    if "piece_no" not in cut_pieces.columns:
        cut_pieces = stored(cut_pieces.withColumn("piece_no", F.monotonically_increasing_id()), "numbered-pieces")
    with_ids = IDS.name in cut_pieces.columns
    count = cut_pieces.count()
    groups = max(1, -(-count // GROUP_PIECES))
    capacity = np.array([most, max_docs, max_cost], np.int64)
    weight = np.array(weights, float)
    number = [pa.field("piece_no", pa.int64())] if with_ids else []
    out = pa.schema([*PIECES, *number, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        length = table["length"].to_numpy()
        demand = np.stack([length, np.ones_like(length), length**2], 1)
        if (demand > capacity).any():
            raise ValueError("a piece exceeds a capacity of the sequences")
        bins, _ = best_fit(demand, capacity, weight, rule)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(length[order])
        starts = ends - length[order]
        new = np.r_[True, bins[order][1:] != bins[order][:-1]] if len(order) else np.zeros(0, bool)
        offset = np.empty_like(length)
        offset[order] = starts - np.maximum.accumulate(np.where(new, starts, 0)) if len(order) else starts
        table = table.select(out.names[:-2])
        return table.append_column("sequence_id", pa.array(key[0].as_py() * (1 << 32) + bins)).append_column("offset", pa.array(offset)).cast(out)

    grouped = cut_pieces.select(*PIECES.names, "piece_no", F.pmod(F.xxhash64("piece_no"), F.lit(groups)).alias("pack_group"))
    if not with_ids:
        grouped = grouped.drop("piece_no")
    placed = grouped.groupBy("pack_group").applyInArrow(
        place, PIECES_DDL + (", piece_no long" if with_ids else "") + ", sequence_id long, offset long"
    )
    if not with_ids:
        return placed
    return placed.join(cut_pieces.select("piece_no", IDS.name), "piece_no").drop("piece_no")


def pack_documents(
    docs: DataFrame, tokenizer: tuple, most: int = 1024, max_docs: int = 1024, max_cost: int | None = None, with_ids: bool = False, **options
) -> DataFrame:
    """Tokenise, cut and pack all documents.

    ``max_cost`` defaults to the cost of one document of full length, which the token
    capacity already implies; lower it to keep sequences of few long pieces apart. Null
    ids and repeated rows are documents of their own. The empty table gives no rows.
    ``with_ids`` adds the token ids of every piece, so the rows of a sequence in the order
    of ``offset`` are its tokens.
    """
    made = stored(pieces(docs, tokenizer, most, with_ids=with_ids).withColumn("piece_no", F.monotonically_increasing_id()), "token-pieces")
    return pack(made, most, max_docs, max_cost or most * most, **options)
