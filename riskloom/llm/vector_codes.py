"""Vector compression by product codes, entries found by Orchard's search.

Vectors are cut into equal parts, each with a small codebook refined by rounds of
assignment and averaging in whole numbers. The nearest entry of a part is found on sorted
neighbour lists: every entry lists all others by distance. A search walks the list of its
current entry; an entry that is nearer becomes current and its list is walked from the
start; entries seen before are marked and skipped. Once the walk comes to an entry more
than twice as far from the current one as the searched part is, nothing ahead can be
nearer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Whole numbers below this cannot overflow squared distances and sums of a batch in 64 bits.
SMALL = 1 << 24
MOST_LONG = (1 << 63) - 1
SEARCHED_AT_ONCE = 16_384


def neighbour_lists(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry all entries by rising squared distance (ties: lower index), and those distances."""
    distance = ((entries[:, None] - entries[None]) ** 2).sum(2)
    order = np.array([sorted(range(len(entries)), key=lambda j, row=row: (row[j], j)) for row in distance.tolist()], np.int64)
    return order, np.take_along_axis(distance, order, 1)


def nearest(parts: np.ndarray, entries: np.ndarray, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry and the squared distance; ties to the lower index.

    All searches move in step: each looks at the next place of its current entry's list.
    ``seen`` gets the number of distances computed.
    """
    lists, far = neighbour_lists(entries)
    n, k = len(parts), len(entries)
    best = np.zeros(n, np.int64)
    distance = ((parts - entries[0]) ** 2).sum(1)
    marked = np.zeros((n, k), bool)
    marked[:, 0] = True
    place = np.zeros(n, np.int64)
    going = np.arange(n)
    computed = n
    while len(going):
        at, now = place[going], best[going]
        on = at < k
        on[on] = np.asarray(far[now[on], at[on]] <= 4 * distance[going[on]], bool)  # beyond twice the distance: done
        going, at, now = going[on], at[on], now[on]
        place[going] += 1
        other = lists[now, at]
        new = ~marked[going, other]
        asked, other = going[new], other[new]
        marked[asked, other] = True
        computed += len(asked)
        d = ((parts[asked] - entries[other]) ** 2).sum(1)
        nearer = np.asarray((d < distance[asked]) | ((d == distance[asked]) & (other < best[asked])), bool)
        jump, to = asked[nearer], other[nearer]
        best[jump], distance[jump], place[jump] = to, d[nearer], 0
    if seen is not None:
        seen.append(computed)
    return best, distance


def whole(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * x); Python integers where 64 bits might not do."""
    x = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
    if np.abs(x).max(initial=0) < SMALL:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x.tolist()], object)


def kept_vectors(vectors: DataFrame, parts: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows with a vector of finite numbers and the table's width: vec_id, label, vector."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), v.alias("vector")).where(F.col("vector").isNotNull() & finite)
    made = stored(rows, "finite-vectors")
    widths = made.groupBy(F.size("vector").alias("width")).count().where((F.col("width") > 0) & (F.col("width") % parts == 0))
    common = widths.orderBy(F.desc("count"), "width").limit(1).collect()
    return made.where(F.size("vector") == (common[0].width if common else -1))


def assigned(vectors: DataFrame, books: list[np.ndarray], scale: int, sums: bool) -> DataFrame:
    """Sums and counts of parts by entry within each task, or code and error of each vector."""
    width = sum(b.shape[1] for b in books)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list]]:
        for batch in batches:
            for at in range(0, batch.num_rows, SEARCHED_AT_ONCE):
                part = batch.slice(at, SEARCHED_AT_ONCE)
                rows = whole(part.column(part.schema.get_field_index("vector")), width, scale)
                pieces = np.split(rows, len(books), axis=1)
                yield part, rows, [(p, *nearest(p, b)) for p, b in zip(pieces, books, strict=True)]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], list] = {}
        for _, _, found in each(batches):
            for part, (pieces, best, _) in enumerate(found):
                order = np.argsort(best, kind="stable")
                entries, first = np.unique(best[order], return_index=True)
                counts = np.diff(np.r_[first, len(best)])
                for e, n, s in zip(entries.tolist(), counts.tolist(), np.add.reduceat(pieces[order], first, axis=0).tolist(), strict=True):
                    have = totals.setdefault((part, e), [0, [0] * len(s)])
                    have[0] += n
                    have[1] = [a + b for a, b in zip(have[1], s, strict=True)]
        if totals:
            yield pa.RecordBatch.from_pylist(
                [{"part": p, "entry": e, "n": n, "sums": list(map(str, s))} for (p, e), (n, s) in totals.items()],
                pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))]),
            )

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, found in each(batches):
            codes = np.stack([best for _, best, _ in found], 1)
            errors = sum(d.astype(object) for _, _, d in found)
            text = [bytes(c).hex() for c in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text), pa.array([min(int(e), MOST_LONG) for e in errors], pa.int64())],
                ["vec_id", "label", "code", "error"],
            )

    if sums:
        return vectors.select("vector").mapInArrow(add_up, "part int, entry int, n long, sums array<string>")
    kinds = dict(vectors.dtypes)
    return vectors.select("vec_id", "label", "vector").mapInArrow(coded, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def mean(key: tuple, sums: pa.Table) -> pa.Table:
    """Rounded-down mean of one entry's parts from the sums of all tasks; exact at any size."""
    n = sum(sums["n"].to_pylist())
    total = [sum(map(int, x)) for x in zip(*sums["sums"].to_pylist(), strict=True)]
    row = {"part": key[0].as_py(), "entry": key[1].as_py(), "mean": [str(t // n) for t in total]}
    return pa.Table.from_pylist([row], pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("mean", pa.list_(pa.string()))]))


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """One codebook per part, from the rows that ``kept_vectors`` gives.

    The driver gets ``entries`` rows at the start and one row per part and entry in a round.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's index takes two hex digits: 1 to 256 entries")
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not first:
        return []
    width = len(first[0].vector)
    seeds = whole(pa.array([r.vector for r in first], pa.list_(pa.float64())), width, scale)
    books = [b.copy() for b in np.split(seeds, parts, axis=1)]
    for _ in range(rounds):
        found = assigned(vectors, books, scale, sums=True)
        for r in found.groupBy("part", "entry").applyInArrow(mean, "part int, entry int, mean array<string>").collect():
            new = [int(x) for x in r.mean]
            if max(map(abs, new)) >= SMALL:
                books[r.part] = books[r.part].astype(object)
            books[r.part][r.entry] = new
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row.

    Rows whose vector is null or holds null or non-finite numbers are dropped, and so are
    those of another width than most (the narrower of equally frequent ones) or whose
    width is no multiple of ``parts``. The first entries are the vectors of the smallest
    ids, null ids last, equal ids by vector; fewer than ``entries`` rows give fewer
    entries. Repeated rows are rows of their own. Sums are exact for numbers of any size;
    errors stop at the largest long. No rows give no rows; other columns are ignored.
    """
    rows = kept_vectors(vectors, parts, id_col, vector_col, label_col)
    books = train(rows, parts, entries, rounds, scale)
    if not books:
        return rows.selectExpr("vec_id", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256")
    codes = stored(assigned(rows, books, scale, sums=False), "vector-codes")
    most = F.lit(MOST_LONG).cast("decimal(38,0)")
    per_label = codes.groupBy(F.col("label").alias("of_label")).agg(
        F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error")
    )
    return codes.join(per_label, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
