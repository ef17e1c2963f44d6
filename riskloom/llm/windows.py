"""Rabin-Karp hashes of word windows over Arrow text, as numpy array work.

Functions here run inside tasks on a bounded piece of a batch. Words are runs of bytes
other than ASCII white space, which in UTF-8 is the same as runs of such characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Odd multipliers, so that they have inverses modulo 2 ** 64.
BYTE_BASE, WORD_BASES = 0x9E3779B97F4A7C15, (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, ..., base ** (n - 1) modulo 2 ** 64, remembered per worker."""
    base %= 1 << 64
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranges_hash(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[starts[i]:ends[i]] from prefix sums."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=sums[1:])
    inverse = powers(pow(base, -1, 1 << 64), n + 1)
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


@dataclass
class Words:
    """Words of a run of texts: byte range, text number and hash of each."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # number of the first word of each text, and the number of words

    def window_hashes(self, size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows that lie in one text, and the windows' hashes."""
        at = np.arange(max(0, len(self.text) - size + 1))
        if len(at):
            at = at[self.text[at] == self.text[at + size - 1]]
        return at, ranges_hash(self.hashes, base, at, at + size)


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts of about ``limit`` bytes.

    Longer texts are a run of their own, never cut. Nulls are empty.
    """
    column = column.cast(pa.large_string()).fill_null("")
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        own = offsets[at : end + 1]
        yield at, end, data[own[0] : own[-1]], own - own[0]
        at = end
    pa.default_memory_pool().release_unused()


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = ~_SPACE[data]
    n = len(data)
    borders = np.zeros(n + 1, bool)
    borders[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | borders[:-1]))
    ends = np.flatnonzero(inside & (~after | borders[1:])) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    values = data.astype(np.uint64) + np.uint64(1)
    hashes = mixed(ranges_hash(values, BYTE_BASE, starts, ends) + (ends - starts).astype(np.uint64))
    first = np.searchsorted(text, np.arange(len(offsets)))
    return Words(data, offsets, starts, ends, text, hashes, first)
