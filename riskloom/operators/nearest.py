"""The nearest rows of many queries inside a task, exactly.

Products of single precision sift the pairs. Those that may reach a query's last place so
far are computed again in double precision, rounded and ranked; ties go by place.
"""

from __future__ import annotations

import numpy as np

from riskloom.operators.similarity import DIGITS

# Queries and rows compared at a time, and pairs that wait to be ranked, to bound the memory of a task.
QUERY_CHUNK = 256
ROW_CHUNK = 4_096
PAIRS = 1 << 20


def equal_rows(units: np.ndarray, kind: np.ndarray | None = None) -> np.ndarray:
    """For every row the number of the first one that has the same values (and kind)."""
    draw = np.random.default_rng(0).integers(1 << 63, size=units.shape[1] + (0 if kind is None else kind.shape[1]), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    key = units.view(np.uint64) @ draw[: units.shape[1]]
    if kind is not None:
        key += kind.astype(np.uint64) @ draw[units.shape[1] :]
    _, first, same = np.unique(key, return_index=True, return_inverse=True)
    first = first[same]
    for at in range(0, len(units), ROW_CHUNK):
        part, own = first[at : at + ROW_CHUNK], np.arange(at, min(at + ROW_CHUNK, len(units)))
        alike = (units[own] == units[part]).all(axis=1)
        if kind is not None:
            alike &= (kind[own] == kind[part]).all(axis=1)
        first[own] = np.where(alike, part, own)
    return first


class Nearest:
    """The ``k`` nearest rows of every query among the pairs that were sifted.

    ``asks`` and ``units`` are unit vectors. ``place`` is the rank of a row in ties and must
    not fall; rows with the same place are listed once. Rows of equal vectors (and equal
    ``kind``) are compared as one: ``rows`` holds the first of them, ``counts`` their number, and rows
    are named by their position in ``rows`` until ``result``. No hit below ``least`` is needed.
    """

    def __init__(self, asks: np.ndarray, units: np.ndarray, k: int, *, place: np.ndarray | None = None,
                 kind: np.ndarray | None = None, least: np.ndarray | None = None):
        first = equal_rows(units, kind)
        self.k, self.all_places = k, np.arange(len(units)) if place is None else place
        self.rows, self.of_row = np.unique(first, return_inverse=True)
        self.counts = np.bincount(self.of_row)
        self.asks, self.units, self.place = asks, units, self.all_places[self.rows]
        if len(self.rows) < len(units):
            self.units = units[self.rows]
        self.asks_32, self.units_32 = asks.astype(np.float32), self.units.astype(np.float32)
        # More than a product of single precision can be off.
        self.margin = (units.shape[1] + 4) * 2.0**-23
        self.least = np.full(len(asks), -np.inf) if least is None else least.astype(float)
        self.pair, self.cosine = np.empty(0, np.int64), np.empty(0)
        self.waiting, self.n_waiting = [], 0
        self._set_bar()

    def _set_bar(self) -> None:
        self.bar = (self.least - self.margin).astype(np.float32)

    def products(self, queries: np.ndarray, rows: np.ndarray | slice) -> np.ndarray:
        return self.asks_32[queries] @ self.units_32[rows].T

    def raise_bar(self, queries: np.ndarray, products: np.ndarray) -> None:
        """Of these products with different rows, no query needs what lies below the ``k``-th."""
        if products.shape[1] >= self.k:
            kth = np.partition(products, -self.k, axis=1)[:, -self.k]
            self.least[queries] = np.maximum(self.least[queries], kth - self.margin)
            self._set_bar()

    def sift(self, queries: np.ndarray, rows: np.ndarray) -> None:
        """Compare queries with rows, both given by their numbers."""
        at = np.flatnonzero(self.products(queries, rows) >= self.bar[queries, None])
        if len(at):
            query, row = np.divmod(at, len(rows))
            self.waiting.append(queries[query] * len(self.rows) + rows[row])
            self.n_waiting += len(at)
            if self.n_waiting > PAIRS:
                self.settle()

    def settle(self) -> None:
        """Rank what waits; a query's bar rises to its last place."""
        if not self.waiting:
            return
        new = np.unique(np.concatenate(self.waiting))
        self.waiting, self.n_waiting = [], 0
        new = new[~np.isin(new, self.pair, assume_unique=True)]
        cosine = np.empty(len(new))
        for at in range(0, len(new), ROW_CHUNK):
            query, row = np.divmod(new[at : at + ROW_CHUNK], len(self.rows))
            cosine[at : at + ROW_CHUNK] = np.einsum("ij,ij->i", self.asks[query], self.units[row])
        pair, cosine = np.r_[self.pair, new], np.r_[self.cosine, np.round(cosine, DIGITS)]
        query, row = np.divmod(pair, len(self.rows))
        order = np.lexsort((self.place[row], -cosine, query))
        nth = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        last = order[nth == self.k - 1]
        self.least[query[last]] = np.maximum(self.least[query[last]], cosine[last])
        self.pair, self.cosine = pair[order[nth < self.k]], cosine[order[nth < self.k]]
        self._set_bar()

    def sift_all(self) -> None:
        """Compare every query with every row."""
        for at in range(0, len(self.asks), QUERY_CHUNK):
            queries = np.arange(at, min(at + QUERY_CHUNK, len(self.asks)))
            if np.isinf(self.least[queries]).any():
                self.raise_bar(queries, self.products(queries, slice(0, ROW_CHUNK)))
            for start in range(0, len(self.rows), ROW_CHUNK):
                self.sift(queries, np.arange(start, min(start + ROW_CHUNK, len(self.rows))))

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and cosine of the hits, by query; rows are those of ``units`` as it was given."""
        self.settle()
        query, row = np.divmod(self.pair, len(self.rows))
        # Rows by their vector and place, those of one place once.
        listed = np.argsort(self.of_row, kind="stable")
        new = np.r_[True, (np.diff(self.of_row[listed]) > 0) | (np.diff(self.all_places[listed]) > 0)]
        listed = listed[new]
        start = np.searchsorted(self.of_row[listed], np.arange(len(self.rows) + 1))
        n = np.minimum(np.diff(start)[row], self.k)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        found = listed[np.repeat(start[row], n) + nth]
        query, cosine = np.repeat(query, n), np.repeat(self.cosine, n)
        order = np.lexsort((self.all_places[found], -cosine, query))
        query, found, cosine = query[order], found[order], cosine[order]
        kept = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        return query[kept], found[kept], cosine[kept]
