"""Shingle sets of whole texts, of five words or as many as asked for, as 64-bit hashes, vectorised over Arrow batches.

Words are runs of bytes other than space and 0x09-0x0D after lower-casing A-Z. A
text with fewer words has one shingle, its whole sequence; one without
words (or null) has none. Two different shingles share a hash with probability
2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import held_for, mix64, utf8_slices

WORDS = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_WEIGHTS = mix64(np.arange(1, 9, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n + 1 of each; they grow to the longest text."""
    powers: list[np.ndarray] = held_for("shingles", list)
    if not powers or len(powers[0]) <= n:
        size = max(1 << 19, n) + 1
        tables = []
        for x in (_BASE, pow(_BASE, -1, 1 << 64)):
            step = np.full(size, x, np.uint64)
            step[0] = 1
            tables.append(np.multiply.accumulate(step))
        powers[:] = tables
    return powers[0], powers[1]


def _word_hashes(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = _LOWER[raw]
    inside = ~_SPACE[low]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets[:-1]] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end[:-1] &= ~inside[1:] | first[1:-1]
    begins, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    power, inverse = _power_tables(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    hashes = mix64((total[ends] - total[begins]) * inverse[begins] + (ends - begins).astype(np.uint64))
    return hashes, np.searchsorted(offsets, begins, "right") - 1


def shingle_sets(texts: pa.Array, size: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of every row of a string array; size: words of a shingle, at most 8."""
    for row, offsets, raw in utf8_slices(texts):
        words, of = _word_hashes(offsets, raw)
        n = len(offsets) - 1
        bounds = np.searchsorted(of, np.arange(n + 1))
        m = max(0, len(words) - size + 1)
        rolled = np.zeros(m, np.uint64)
        for k in range(size):
            rolled += words[k : k + m] * _WEIGHTS[k]
        rolled = mix64(rolled)
        for d in range(n):
            a, b = bounds[d], bounds[d + 1]
            if b - a >= size:
                yield row + d, np.unique(rolled[a : b - size + 1])
            elif b > a:
                short = (words[a:b] * _WEIGHTS[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.full(1, b - a, np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                yield row + d, mix64(short)
            else:
                yield row + d, np.zeros(0, np.uint64)
