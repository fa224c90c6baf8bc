"""Vectorised text kernels over Arrow buffers: slices of documents, words and 64-bit hashes of any byte interval."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

SLICE = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)
_BYTE = np.uint64(0x5C1B7E2D9F3A4C61)


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, local offsets) of runs of rows of about limit bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(size, _ODD, np.uint64)
        down = np.full(size, _INV, np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of byte intervals [s, e) in constant time each; equal bytes have equal hashes anywhere."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(12, int(len(data) + 1).bit_length())
        up, self.down = _powers(size)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, np.uint64)
            terms = data.astype(np.uint64)
            terms += _BYTE
            terms *= up[: len(data)]
            np.cumsum(terms, out=self.sums[1:])

    def __call__(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[e] - self.sums[s]) * self.down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@lru_cache(maxsize=1)
def _space() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[0x20, *range(9, 14)]] = True
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of other than separators (ASCII white space); rows bound words too."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~(_space() if separators is None else separators)[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1
