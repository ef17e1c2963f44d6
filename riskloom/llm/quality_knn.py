"""Quality by nearest-neighbour voting in a latent-semantic space.

A text becomes counts of terms of three kinds, each hashed to places of its own: words,
runs of three bytes (letter n-grams of any script), and runs of two and three character
classes (lower and upper case, digits, each kind of punctuation); and how many of its
five-word windows are repeats. Term weights (log count, inverse document frequency; each
kind of unit length) and the latent-semantic projection (truncated SVD) are fitted on a
bounded sample of labelled texts. Every
document is compared with all labelled vectors of the sample by exact cosine products,
block by block; its ``NEIGHBOURS`` nearest ones vote with their similarity as weight.

What is broadcast has a fixed bound: ``SAMPLE`` x ``RANK`` numbers and the projection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.windows import WORD_BASES, pieces, words_of

SHAPES, WORDS, LETTERS, EXTRA = 1024, 2048, 1024, 2
TERMS = SHAPES + WORDS + LETTERS
#: Places and weight of each kind of term.
KINDS = ((0, SHAPES, 1.0), (SHAPES, SHAPES + WORDS, 0.5), (SHAPES + WORDS, TERMS, 0.5))
RANK = 48
SAMPLE = 4096
NEIGHBOURS = 15
BLOCK = 1024  # texts compared at once
NORM_ROWS = 256  # texts weighted at once
POWER = 8  # weight of a neighbour: cosine ** POWER
REPEAT_WEIGHT = 4.0

# Character classes by byte. What is not named is other punctuation.
_CLASSES = ["", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".", ",", "!", "?",
            "#", "*", "$", "%", "&", "|", "<>", "@", "'\"", ":;", "-_", "()[]{}", "/\\="]
_CLASS = np.zeros(256, np.uint32)
for _number, _characters in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _characters]] = _number
_CLASS[0x80:] = 1  # letters beyond ASCII


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x (TERMS + EXTRA) counts of a run of whole texts."""
    n = len(offsets) - 1
    kinds = _CLASS[data]
    text = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros((n, TERMS + EXTRA), np.float32)
    half = SHAPES // 2
    for symbols, size, base, places in ((kinds, 2, 0, half), (kinds, 3, half, half), (data.astype(np.uint32), 3, SHAPES + WORDS, LETTERS)):
        if len(symbols) < size:
            continue
        code = np.zeros(len(symbols) - size + 1, np.uint32)
        for k in range(size):
            code = code * np.uint32(31 if symbols is kinds else 257) + symbols[k : k + len(code)]
        term = (code * np.uint32(2654435761)) >> np.uint32(32 - places.bit_length() + 1)
        whole = text[: len(code)] == text[size - 1 :]
        flat = text[: len(code)][whole] * np.int64(places) + term[whole]
        out[:, base : base + places] = np.bincount(flat, minlength=n * places).reshape(n, places)
    found = words_of(data, offsets)
    at, hashes = found.window_hashes(1, WORD_BASES[0])
    flat = found.text[at] * np.int64(WORDS) + (hashes % np.uint64(WORDS)).astype(np.int64)
    out[:, SHAPES : SHAPES + WORDS] = np.bincount(flat, minlength=n * WORDS).reshape(n, WORDS)
    at, hashes = found.window_hashes(5, WORD_BASES[0])
    if len(at):
        owner = found.text[at]
        order = np.lexsort((hashes, owner))
        same = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        repeats = np.bincount(owner[order][1:][same], minlength=n)
        total = np.bincount(owner, minlength=n)
        out[:, TERMS] = repeats / np.maximum(total, 1)
        out[:, TERMS + 1] = (total - repeats) / np.maximum(total, 1)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Relative log counts times inverse document frequency, each kind of unit length times its weight.

    ``out`` may be ``counts``, which then are replaced; norms are taken of a few rows at a time.
    """
    if out is None:
        out = np.empty(counts.shape, np.float32)
    for start in range(0, len(counts), NORM_ROWS):
        part, weights = counts[start : start + NORM_ROWS], out[start : start + NORM_ROWS]
        terms = weights[:, :TERMS]
        np.log1p(part[:, :TERMS], out=terms)
        terms *= idf
        for a, b, weight in KINDS:
            terms[:, a:b] *= weight / np.maximum(np.linalg.norm(terms[:, a:b], axis=1, keepdims=True), 1e-9)
        weights[:, TERMS] = np.sqrt(part[:, TERMS]) * (REPEAT_WEIGHT / 4)
        weights[:, TERMS + 1 :] = 0
    return out


def latent(counts: np.ndarray, model: dict) -> np.ndarray:
    x = weighted(counts, model["idf"])
    x -= model["mean"]
    return of_unit_length(x @ model["axes"])


def of_unit_length(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def leading_axes(x: np.ndarray) -> np.ndarray:
    """The first RANK right singular vectors, by subspace iteration from a fixed start."""
    rank = min(RANK + 16, x.shape[1])
    axes = np.linalg.qr(np.random.default_rng(7).normal(size=(x.shape[1], rank)).astype(np.float32))[0]
    for _ in range(8):
        axes = np.linalg.qr(x.T @ (x @ axes))[0]
    _, _, turn = np.linalg.svd(x @ axes, full_matrices=False)
    return (axes @ turn.T)[:, :RANK].astype(np.float32)


def fit(counts: np.ndarray, labels: np.ndarray) -> dict:
    """Projection and labelled vectors from the sample's counts, whose place the weights take."""
    n = max(1, len(counts))
    idf = np.log((1 + n) / (1 + np.count_nonzero(counts[:, :TERMS], axis=0))) + 1
    model = {"idf": idf.astype(np.float32)}
    x = weighted(counts, model["idf"], out=counts)
    model["mean"] = x.mean(0) if len(x) else np.zeros(TERMS + EXTRA, np.float32)
    x -= model["mean"]
    model["axes"] = leading_axes(x)
    model["vectors"] = of_unit_length(x @ model["axes"]).astype(np.float32)
    model["labels"] = labels.astype(np.float32)
    return model


def vote(counts: np.ndarray, model: dict) -> np.ndarray:
    """Weighted share of label 1 among the nearest labelled vectors, block by block."""
    out = np.empty(len(counts))
    for a in range(0, len(counts), BLOCK):
        cosine = latent(counts[a : a + BLOCK], model) @ model["vectors"].T
        k = min(NEIGHBOURS, cosine.shape[1])
        nearest = np.argpartition(cosine, -k, axis=1)[:, -k:]
        weight = np.maximum(np.take_along_axis(cosine, nearest, 1), 1e-6) ** POWER
        out[a : a + BLOCK] = (weight * model["labels"][nearest]).sum(1) / weight.sum(1)
    return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def packed_row(counts: np.ndarray) -> bytes:
    """Places and values that are not zero."""
    at = np.flatnonzero(counts)
    return at.astype("<u2").tobytes() + counts[at].astype("<f4").tobytes()


def unpacked_row(data: bytes, out: np.ndarray) -> None:
    n = len(data) // 6
    out[np.frombuffer(data, "<u2", n)] = np.frombuffer(data, "<f4", n, 2 * n)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in pieces(batch.column(1), 1_000_000):
            counts = term_counts(data, offsets)
            rows = pa.array([packed_row(c) for c in counts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), rows], ["quality", "counts"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict:
    """Model fitted on at most ``sample`` labelled texts that are not held out.

    The sample is the lowest hashes of the ids, so it does not depend on the input's order;
    of rows with the same id one text counts, the one of the lowest hash.
    """
    known = labels.where("quality IN (0, 1)").groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").cast("int").alias("quality"))
    chosen = known.where(~held_out(F.col("label_id"))).orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    texts = (
        docs.where(F.col(text_col).isNotNull()).join(chosen, F.col(id_col) == F.col("label_id"))
        .groupBy("label_id").agg(F.first("quality").alias("quality"), F.min_by(F.col(text_col), F.xxhash64(text_col)).alias("text"))
    )
    rows = texts.select("quality", "text").mapInArrow(_counted, "quality int, counts binary").collect()  # at most ``sample``
    rows.sort(key=lambda r: (r["quality"], bytes(r["counts"])))
    qualities = np.array([r["quality"] for r in rows], np.float32)
    counts = np.zeros((len(rows), TERMS + EXTRA), np.float32)
    for out in counts[::-1]:
        unpacked_row(bytes(rows.pop()["counts"]), out)
    return fit(counts, qualities)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text.

    Null texts and texts without words score 0: nothing speaks for them. Without any
    labelled text every score is 0. Repeated rows get equal scores; the empty table gives
    no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(1), 1_000_000):
                counts = term_counts(data, offsets)
                some = np.diff(words_of(data, offsets).first) > 0
                out = np.zeros(b - a)
                if len(fitted["labels"]) and some.any():
                    out[some] = vote(counts[some], fitted)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(out)], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def keep(docs: DataFrame, model: dict, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``least``; same columns, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(at), 1_000_000):
                some = np.diff(words_of(data, offsets).first) > 0
                good = np.zeros(b - a, bool)
                if len(fitted["labels"]) and some.any():
                    good[some] = vote(term_counts(data, offsets)[some], fitted) >= least
                yield batch.slice(a, b - a).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
