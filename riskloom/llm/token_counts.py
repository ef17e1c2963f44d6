"""Token counts of documents without token ids.

Documents are taken in chunks of bounded size. A chunk keeps how often each pre-token of
its dictionary occurs in each document, and deals its dictionary to buckets by hash. A
bucket's task sees equal pre-tokens of all chunks, counts the pieces of each once, and
answers every chunk with the counts of its part of the dictionary. A document's tokens are
its frequencies times these counts, added up. Token ids never leave the library. A
pre-token of all documents is one entry a chunk, so no bucket runs hot.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import tokenizing
from riskloom.llm.common import partitions, stored

CHUNK_CHARS = 4_000_000
CHUNK_ROWS = 32_768
REMEMBERED = 300_000  # units whose pre-tokens a worker keeps

DICTIONARY = pa.schema([
    ("chunk", pa.int64()), ("bucket", pa.int32()),
    # A row of a bucket: its pre-tokens in the chunk.
    ("pre_tokens", pa.binary()),
    # The chunk's own row, without a bucket: documents, and (document, pre-token, times) packed.
    ("doc_id", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("n_special", pa.list_(pa.int32())), ("frequencies", pa.binary()),
])
DICTIONARY_DDL = (
    "chunk long, bucket int, pre_tokens binary, doc_id array<long>, n_bytes array<long>, n_special array<int>, frequencies binary"
)
ANSWER = pa.schema([("to_chunk", pa.int64()), ("from_bucket", pa.int32()), ("pieces", pa.list_(pa.int32()))])
COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def packed_words(words: list[str]) -> bytes:
    return tokenizing.packed(list(map(len, words))) + zstandard.ZstdCompressor(level=3).compress("".join(words).encode())


def unpacked_words(data: bytes) -> list[str]:
    (lengths,), at = tokenizing.unpacked(data, 0, 1)
    text = zstandard.ZstdDecompressor().decompress(data[at:]).decode()
    ends = [0, *np.cumsum(lengths).tolist()]
    return [text[i:j] for i, j in zip(ends, ends[1:], strict=False)]


def bucket_of(pre_token: str, buckets: int) -> int:
    return zlib.crc32(pre_token.encode()) % buckets


def dictionaries(docs: DataFrame, path: str, buckets: int) -> DataFrame:
    """Per chunk one row of frequencies, and one row of its pre-tokens for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizing.load(path)
        task = TaskContext.get().partitionId() << 32
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        known: dict[str, list[str]] = {}
        for at, chunk in enumerate(tokenizing.chunks(rows, 1, CHUNK_CHARS, CHUNK_ROWS)):
            if len(known) > REMEMBERED:
                known.clear()
            unit_of, part_of = tokenizing.Numbers(), tokenizing.Numbers()
            used, n_units, special = [], [], []
            for _, text, _ in chunk:
                segments, n = tokenizer.segments(text or "")
                before = len(used)
                for segment in segments:
                    used += map(unit_of.__getitem__, tokenizing.units(segment))
                n_units.append(len(used) - before)
                special.append(n)
            parts, ends = [], [0]
            for u in unit_of:
                if u not in known:
                    known[u] = tokenizer.pre_tokens(u)
                parts += map(part_of.__getitem__, known[u])
                ends.append(len(parts))
            where, unit = tokenizing.expanded(np.array(used, np.int64), np.array(ends))
            owner = np.repeat(np.arange(len(chunk)), n_units)[unit]
            keys, times = np.unique(owner << 32 | np.array(parts, np.int64)[where], return_counts=True)
            # Within a document parts rise, and new ones follow each other: small steps.
            steps = np.diff(keys & 0xFFFFFFFF, prepend=0)
            per_doc = np.bincount(keys >> 32, minlength=len(chunk))
            doc, _, n_bytes = zip(*chunk, strict=True)
            bucket = [bucket_of(p, buckets) for p in part_of]
            own = [task + at, None, None, doc, n_bytes, special, tokenizing.packed(steps, times) + tokenizing.packed(per_doc) + tokenizing.packed(bucket)]
            dealt: dict[int, list[str]] = {}
            for p, b in zip(part_of, bucket, strict=True):
                dealt.setdefault(b, []).append(p)
            made = [own, *([task + at, b, packed_words(p), None, None, None, None] for b, p in dealt.items())]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), DICTIONARY, strict=True)], schema=DICTIONARY)

    return docs.mapInArrow(count, DICTIONARY_DDL)


def answers(dictionary: DataFrame, path: str, buckets: int) -> DataFrame:
    """Pieces of the pre-tokens of every chunk's share of a bucket, each counted once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known = tokenizing.load(path), {}
        for batch in batches:
            words = batch.column("pre_tokens")
            for i in range(batch.num_rows):
                found = unpacked_words(words[i].as_py())
                for w in found:
                    if w not in known:
                        known[w] = tokenizer.n_pieces(w)
                pieces = pa.array([[known[w] for w in found]], ANSWER.field("pieces").type)
                yield pa.RecordBatch.from_arrays([batch.column("chunk").slice(i, 1), batch.column("bucket").slice(i, 1), pieces], schema=ANSWER)

    return dictionary.repartition(buckets, "bucket").mapInArrow(count, "to_chunk long, from_bucket int, pieces array<int>")


def sums(own: pa.Table, answer: pa.Table) -> pa.Table:
    """Tokens of a chunk's documents."""
    row = {n: own[n].combine_chunks() for n in own.column_names}
    data = row["frequencies"][0].as_py()
    (steps, times), at = tokenizing.unpacked(data, 0, 2)
    (per_doc,), at = tokenizing.unpacked(data, at, 1)
    (bucket,), _ = tokenizing.unpacked(data, at, 1)
    # Answers come in the order of the dictionary within each bucket.
    pieces = np.zeros(len(bucket), np.int64)
    found = dict(zip(answer["from_bucket"].to_pylist(), answer["pieces"].combine_chunks(), strict=True))
    if found:
        pieces[np.argsort(bucket, kind="stable")] = np.concatenate([found[b].values.to_numpy() for b in sorted(found)])
    running = np.r_[0, np.cumsum(pieces[np.cumsum(steps)] * times)]
    tokens = np.diff(running[np.cumsum(np.r_[0, per_doc])]) + row["n_special"].flatten().to_numpy()
    return pa.Table.from_arrays([row["doc_id"].flatten(), row["n_bytes"].flatten(), pa.array(tokens, pa.int64())], schema=COUNTS)


def token_counts(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    ``path`` is a ``tokenizers`` (``.json``) or ``sentencepiece`` (``.model``) file. Special
    strings inside texts are what the library takes them for by default: one token each
    for ``tokenizers``, plain text for ``sentencepiece``. Null and empty texts have no
    bytes and no tokens. Null ids and repeated rows are rows of their own; ids are
    integers. No rows give no rows; other columns are ignored.
    """
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
    )
    buckets = partitions(docs)
    made = stored(dictionaries(texts, path, buckets), "pre-tokens")
    known = answers(made.where(F.col("bucket").isNotNull()).select("chunk", "bucket", "pre_tokens"), path, buckets)
    return (
        made.where(F.col("bucket").isNull()).select("chunk", "doc_id", "n_bytes", "n_special", "frequencies")
        .groupBy("chunk").cogroup(known.groupBy("to_chunk"))
        .applyInArrow(sums, "doc_id long, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
