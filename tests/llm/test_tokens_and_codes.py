"""Token counts, tokenizer alignment and vector codes against the libraries and plain loops."""

import hashlib
import math
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from riskloom.llm import alignment, catalog, token_counts, tokenizing, vector_codes

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = [
    None, "", "a", "a ", " a", "  ", "a  b", "a \n b", "\n\n a​ b \x1c c 　　 d", "it's ab's 'S", "▁", "a ▁ b",
    "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>", "<s> <0x41> </s>", "<|startoftext|> ΟΔΟΣ Straße", "᠎ x᠎ y",
    "👍🏽 日本語 é", "\x00 \x00", "word " * 5_000, "x" * 20_000, "same", "same",
]


@pytest.fixture(scope="module")
def texts(spark, documents):
    odd = [(i, t, "extra") for i, t in enumerate(ODD)] + [(None, "no id", "extra"), (None, None, None), (3, "same id", "extra")]
    return spark.createDataFrame(odd, "doc_id long, text string, chunk string").unionByName(documents.select("doc_id", "text"), allowMissingColumns=True).cache()


def rows(df, *names):
    return sorted((r.doc_id is not None, r.doc_id or 0, *(r[n] for n in names)) for r in df.collect())


@pytest.mark.parametrize("path", [BYTES, WORDS, PIECES])
def test_counts_are_the_librarys(texts, path):
    if path.endswith("json"):
        library = Tokenizer.from_file(path)
        n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    else:
        library = SentencePieceProcessor(model_file=path)
        n = lambda t: len(library.encode(t))
    want = sorted((r.doc_id is not None, r.doc_id or 0, len((r.text or "").encode()), k := n(r.text or ""), k > 1024) for r in texts.collect())
    assert rows(token_counts.token_counts(texts, path, 1024), "n_bytes", "n_tokens", "over_limit") == want


def test_counts_of_small_chunks(texts, monkeypatch):
    want = rows(token_counts.token_counts(texts, BYTES, 1024), "n_bytes", "n_tokens")
    monkeypatch.setattr(token_counts, "CHUNK_CHARS", 5_000)
    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    assert rows(token_counts.token_counts(texts, BYTES, 1024), "n_bytes", "n_tokens") == want
    assert token_counts.token_counts(texts.limit(0), BYTES, 1024).collect() == []


def test_registered_counts(spark, data):
    library = Tokenizer.from_file(BYTES)
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in catalog.table(spark, data, "documents").collect()}
    assert {r.doc_id: r.n_tokens for r in catalog.op13(spark, data).collect()} == want


def aligned_plainly(pairs):
    """The contract read out loud, text by text."""
    a, b = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    bytes_a = tokenizing.load(BYTES, True).token_bytes()
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    made = []
    for doc, text in pairs:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        left, right = [bytes_a[i] for i in x], [bytes_b(i) for i in y]
        if not text or b"".join(left) != (" " + text).encode() or b"".join(right) != (" " + text).encode():
            made.append((doc, 0, 0, [], [], ""))
            continue
        ends_a, ends_b = (dict(zip(np.cumsum([len(t) for t in side]).tolist(), ids, strict=True)) for side, ids in ((left, x), (right, y)))
        groups, links, now = [], [], ([], [])
        for end in sorted({*ends_a, *ends_b}):
            for ids, side in ((ends_a, 0), (ends_b, 1)):
                if end in ids:
                    now[side].append(ids[end])
            if end in ends_a and end in ends_b:
                links.append((ends_a[end], ends_b[end]))
                groups.append("|".join(",".join(map(str, s)) for s in now))
                now = ([], [])
        made.append((doc, len(x), len(y), groups, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(link for m in made for link in m[4])
    highest = {}
    for (_, j), n in count.items():
        highest[j] = max(n, highest.get(j, 0))
    return sorted(
        (doc is not None, doc or 0, n_a, n_b, len(groups), len(links), sum(count[x] == highest[x[1]] for x in links), sum(count[x] for x in links), sha)
        for doc, n_a, n_b, groups, links, sha in made
    )


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("small", [False, True])
def test_alignment(texts, monkeypatch, small):
    """Also with many small chunks, runs of many blocks and every cell split."""
    if small:
        for name, value in (("CHUNK_CHARS", 20_000), ("BLOCK", 16), ("REMEMBERED", 10), ("CELLS", 4)):
            monkeypatch.setattr(alignment, name, value)
    got = alignment.align(texts, BYTES, PIECES, cell_bytes=2_000 if small else alignment.CELL_BYTES)
    assert rows(got, *COLUMNS) == aligned_plainly([(r.doc_id, r.text) for r in texts.collect()])


def test_alignment_of_nothing(texts):
    assert alignment.align(texts.limit(0), BYTES, PIECES).collect() == []
    assert {tuple(r)[1:] for r in alignment.align(texts.where("text IS NULL"), BYTES, PIECES).collect()} == {(0, 0, 0, 0, "", 0, 0)}


def test_merge_of_runs():
    """Batches hold whole B ids in order, whatever the blocks."""
    rng = np.random.default_rng(3)
    old, alignment.BLOCK = alignment.BLOCK, 7
    try:
        runs, want = [], Counter()
        for run in range(9):
            keys = np.unique(rng.integers(0, 60, 200) << alignment.DOC_BITS | rng.integers(0, 9, 200))
            keys = keys if run else keys[:1]
            runs.append(alignment.write_run(keys, np.full(len(keys), run + 1)))
            for k in keys.tolist():
                want[k >> alignment.DOC_BITS, run, k & 15] += run + 1
        got, last = Counter(), -1
        for pair, run, place, times in alignment.merged(runs, 5):
            assert list(pair) == sorted(pair) and pair[0] // 5 > last
            last = pair[-1] // 5
            for x in zip(pair.tolist(), run.tolist(), place.tolist(), times.tolist(), strict=True):
                got[x[:3]] += x[3]
        assert got == want
    finally:
        alignment.BLOCK = old


def test_orchard_search_is_exact():
    rng = np.random.default_rng(1)
    entries = rng.integers(-40, 40, (16, 8))
    entries[5] = entries[9]  # ties go to the lower index
    parts = np.concatenate([rng.integers(-40, 40, (3_000, 8)), entries, (entries[:1] + entries[1:2]) // 2])
    distance = ((parts[:, None] - entries[None]) ** 2).sum(2)
    best, found = vector_codes.nearest(parts, entries)
    assert (best == distance.argmin(1)).all() and (found == distance.min(1)).all()
    exact = vector_codes.nearest(parts.astype(object) * 10**30, entries.astype(object) * 10**30)
    assert (exact[0] == best).all() and exact[1][0] == int(found[0]) * 10**60


def test_orchard_search_prunes():
    """Where entries lie in groups, many distances are never computed."""
    rng = np.random.default_rng(2)
    entries = np.repeat(np.arange(4) * 10_000, 4)[:, None] + rng.integers(0, 100, (16, 8))
    parts = entries[rng.integers(0, 16, 2_000)] + rng.integers(-5, 5, (2_000, 8))
    seen = []
    vector_codes.nearest(parts, entries, seen)
    assert seen[0] < 0.75 * 16 * 2_000


def coded_plainly(vectors):
    """[(id, label, vector)] in order of id."""
    kept = [(i, label, [math.floor(4096 * x) for x in v]) for i, label, v in vectors]
    w = len(kept[0][2]) // 8
    parts = [[v[p * w : (p + 1) * w] for p in range(8)] for _, _, v in kept]
    books = [[row[p] for row in parts[:16]] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    find = lambda row: [min(range(len(books[p])), key=lambda e, p=p: (far(row[p], books[p][e]), e)) for p in range(8)]
    for _ in range(6):
        at = [find(row) for row in parts]
        for p in range(8):
            for e in range(len(books[p])):
                mine = [row[p] for row, a in zip(parts, at, strict=True) if a[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    at = [find(row) for row in parts]
    errors = [sum(far(row[p], books[p][a[p]]) for p in range(8)) for row, a in zip(parts, at, strict=True)]
    by_label = Counter()
    for (_, label, _), e in zip(kept, errors, strict=True):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    most = (1 << 63) - 1
    return [(i, bytes(a).hex(), min(e, most), min(by_label[label], most), sha) for (i, label, _), a, e in zip(kept, at, errors, strict=True)]


KIND = "vec_id long, embedding array<double>, label int, code string, vector int"


@pytest.mark.parametrize("n", [3, 60])
def test_codes_and_odd_vectors(spark, n):
    rng = np.random.default_rng(n)
    good = [(i, rng.normal(size=16).tolist(), [0, None, 2][i % 3], "clash", 1) for i in range(n)]
    good[1] = (1, good[0][1], 0, None, None)  # a tie
    good[-1] = (n - 1, [1e25, -3e9, *good[-1][1][2:]], 2, "x", 0)  # beyond 64 bits when squared
    odd = [(900, None, 0), (901, [], 0), (902, [1.0, None] * 8, 0), (903, [float("nan")] * 16, 0), (904, [math.inf] + [0.0] * 15, 1), (905, [1.0] * 8, 0), (906, [1.0] * 15, 0)]
    df = spark.createDataFrame(good + [(*o, None, None) for o in odd], KIND).repartition(3)
    got = sorted(tuple(r) for r in vector_codes.compress(df).collect())
    want = coded_plainly([(i, label, v) for i, v, label, _, _ in good])
    if n > 3:
        assert got == want
    else:
        assert [g[:2] for g in got] == [w[:2] for w in want]


def test_codes_of_repeated_and_null_ids(spark):
    rows_ = [(None, [float(i % 5)] * 8, None) for i in range(30)] + [(7, [2.5] * 8, 1)] * 4
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>, label int")
    got = vector_codes.compress(df).collect()
    assert len(got) == 34 and len({(r.code, r.label_error) for r in got if r.vec_id == 7}) == 1
    assert {r.label_error for r in got if r.vec_id is None} == {sum(r.error for r in got if r.vec_id is None)}
    assert all(r.error == 0 for r in got if r.vec_id == 7)
    assert vector_codes.compress(df.limit(0)).collect() == []
    assert vector_codes.compress(df.where("false").union(df.selectExpr("vec_id", "array()", "label"))).collect() == []


def test_whole_numbers_round_down():
    got = vector_codes.whole(pa.array([[-0.0001, 0.0001, -1.0, 0.5]]), 4, 4096)
    assert got.tolist() == [[-1, 0, -4096, 2048]]
