"""Rolling hashes over the bytes or words of an Arrow text column, for use inside tasks.

All arithmetic is modulo 2**64 on whole arrays: a prefix sum of symbol times power gives the hash of any window by one
subtraction and one multiplication with the inverse power.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: everything but ASCII letters and digits and what is outside ASCII
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _tables.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _tables[base] = np.cumprod(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of each hash over all its bits (in place)."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Prefix:
    """Hashes of any range of a symbol array."""

    def __init__(self, symbols: np.ndarray):
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        values = symbols.astype(np.uint64)
        values += np.uint64(1)
        values *= _powers(_BASE, len(symbols))
        np.cumsum(values, out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self.sums[end]
        h -= self.sums[start]
        h *= _powers(_INVERSE, len(self.sums))[start]
        return mix(h)

    def windows(self, width: int) -> np.ndarray:
        n = max(0, len(self.sums) - width)
        h = self.sums[width:width + n] - self.sums[:n]
        h *= _powers(_INVERSE, n)
        return mix(h)


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds) of consecutive rows of about ``limit`` bytes; a longer row comes alone, null is empty."""
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, body = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1
        last = min(max(last, row + 1), n)
        yield row, data[bounds[row]:bounds[last]], bounds[row:last + 1] - bounds[row]
        row = last


def words(data: np.ndarray, bounds: np.ndarray,
          blank: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every word that ``blank`` bytes (ASCII white space) delimit, and each document's word bounds."""
    inside = ~blank[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    before = np.empty(len(data), bool)
    before[:1] = True
    np.logical_not(inside[:-1], out=before[1:])
    starts = np.flatnonzero(inside & (before | cut[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = True
    np.logical_not(inside[1:], out=after[:-1])
    ends = np.flatnonzero(inside & (after | cut[1:])) + 1
    return starts, ends, Prefix(data).ranges(starts, ends), np.searchsorted(starts, bounds)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values."""
    n, have, span = len(values) - width + 1, values, 1
    while span * 2 <= width:
        have = np.minimum(have[:-span], have[span:])
        span *= 2
    return np.minimum(have[:n], have[width - span:width - span + n])


def runs(prefix: Prefix, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Group the windows of ``length`` symbols of each document into runs that share a seed.

    The seed of a window is a shorter stretch that its content alone selects: the position of the least hash of
    ``length // 3``-symbol stretches, modulo the number of seed positions. Equal windows so have equal seeds, wherever they
    stand, and neighbours mostly share theirs. Returns (document, first window, number of windows, seed hash, run hash).
    """
    small, spots = max(1, length * 3 // 10), max(1, length * 36 // 100)
    n = len(prefix.sums) - 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    bits = np.uint64(max(1, int(n).bit_length()))
    marks = prefix.windows(small)
    marks >>= bits
    marks <<= bits
    marks |= np.arange(len(marks), dtype=np.uint64)
    at = least(marks, length - small + 1)
    del marks
    at &= (np.uint64(1) << bits) - np.uint64(1)
    here = np.arange(len(at), dtype=np.int64)
    seed = here + (at.astype(np.int64) - here) % spots
    del at
    document = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:len(here)]
    valid = here + length <= bounds[document + 1]
    here, seed, document = here[valid], seed[valid], document[valid]
    if not len(here):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.empty(len(here), bool)
    new[0] = True
    new[1:] = (seed[1:] != seed[:-1]) | (document[1:] != document[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(here)))
    start, seed, document = here[first], seed[first], document[first]
    return (document, start, count, prefix.ranges(seed, seed + (length - spots + 1)),
            prefix.ranges(start, start + count + (length - 1)))


def covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the positions that lie in at least one [start, end)."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:size]) > 0
