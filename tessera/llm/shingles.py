"""Word shingles of whole texts as 64-bit hashes, computed over the bytes of many rows at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import byte_view, row_slices

_SEED = np.random.default_rng(20261126).integers(1, 2**62, 80, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_SEED[0])
#: Bytes hashed in one go; a longer row is cut at white space.
SLICE = 1 << 19

#: A-Z to lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
        for table, base in ((up, _BASE), (down, inverse)):
            table[0], filled, step = 1, 1, base
            while filled < size:  # doubling: the second half is the first times base^filled
                more = min(filled, size - filled)
                table[filled : filled + more] = table[:more] * np.uint64(step)
                filled, step = filled + more, step * step % (1 << 64)
        _powers[:] = [up, down]
    return _powers[0], _powers[1]


def mixed(h: np.ndarray, k: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values; another one for each k."""
    h = (h ^ (h >> np.uint64(32))) * _SEED[60 + k]
    h = (h ^ (h >> np.uint64(29))) * _SEED[70 + k]
    return h ^ (h >> np.uint64(32))


def _hash_words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word in `data`; no word crosses an offset in `breaks`."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    data = LOWER[data]
    word = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[breaks] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | cut[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | cut[1:n]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last)
    up, down = _power_tables(n)
    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n])
    h = sums[stops] - np.where(starts > 0, sums[starts - 1], np.uint64(0))
    return starts, mixed(h * down[starts])


def _hash_long(data: np.ndarray) -> np.ndarray:
    """Word hashes of one long row, a piece at a time, cut at white space."""
    parts, low = [], 0
    while low < len(data):
        high = min(len(data), low + SLICE)
        if high < len(data):
            gaps = np.flatnonzero(SPACE[data[low:high]])
            if len(gaps):
                high = low + int(gaps[-1]) + 1
            else:  # a word longer than a slice is taken whole
                while high < len(data) and not SPACE[data[high]]:
                    high += 1
        parts.append(_hash_words(data[low:high], np.zeros(1, np.int64))[1])
        low = high
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(low, high, hashes, bounds) for row ranges of a large_string column; row low+i has hashes[bounds[i]:bounds[i+1]]."""
    flat, ends = byte_view(column)
    for low, high in row_slices(ends, SLICE):
        data = flat[ends[low] : ends[high]]
        if len(data) > SLICE:
            h = _hash_long(data)
            yield low, high, h, np.asarray([0, len(h)])
        else:
            offsets = ends[low : high + 1] - ends[low]
            starts, h = _hash_words(data, offsets)
            yield low, high, h, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes; a row of fewer words gives one for its whole sequence."""
    for low, high, h, bounds in word_hashes(column):
        rolled = np.zeros(max(0, len(h) - size + 1), np.uint64)
        for k in range(size):
            rolled += h[k : k + len(rolled)] * _SEED[1 + k]
        rolled = mixed(rolled)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= size:
                yield np.unique(rolled[a : b - size + 1])
            elif b > a:
                whole = (h[a:b] * _SEED[30 : 30 + b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mixed(np.asarray([whole], np.uint64), 1)
            else:
                yield np.zeros(0, np.uint64)
