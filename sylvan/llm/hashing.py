"""Vectorised tokens and 64-bit hashes over byte buffers.

The hash of a string is a polynomial in an odd base modulo 2**64, taken from prefix sums, then mixed. Equal strings have
equal hashes; different ones differ but for a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from sylvan.llm.util import bytes_of

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that are hashed at one go.
PIECE = 1 << 18

IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[65:91] += 32
#: True where a byte belongs to a word: all but [\x20\x09-\x0D].
WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
#: True for ASCII letters and digits and all bytes above ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; starts must not fall. Long buffers are done in pieces that end between spans."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        low = int(starts[a])
        b = max(a + 1, int(np.searchsorted(starts, low + PIECE)))
        high = int(ends[a:b].max())
        up, down = powers(BASE, high - low + 1), powers(INVERSE, int(starts[b - 1]) - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        s, e = starts[a:b] - low, ends[a:b] - low
        out[a:b] = (sums[e] - sums[s]) * down[s]
        a = b
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Tokens(NamedTuple):
    """Tokens of a column of texts: hash, first and end byte, and the row each is of, in order."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    #: Tokens of row k are first[k]:first[k + 1].
    first: np.ndarray
    data: np.ndarray


def tokens(column: pa.ChunkedArray | pa.Array, word: np.ndarray = WORD, lower: bool = True) -> Tokens:
    """The maximal runs of word bytes of each text."""
    data, offsets = bytes_of(column)
    if lower:
        data = LOWER[data]
    inside = word[data]
    # A token also ends where a text ends.
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    begins[cuts] |= inside[cuts]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    closes[last] |= inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Tokens(span_hashes(data, start, end), start, end, row, first, data)


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of all but its last item and that of the last."""
    return mix(left * np.uint64(0xA24BAED4963EE407) + (right ^ np.uint64(0x9FB21C651E98DF25)))


def shingles(t: Tokens, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k tokens and their rows; a row with fewer tokens, but one at least, has all of them as one."""
    n = np.diff(t.first)
    if not len(t.hash):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    value, row = t.hash.copy(), t.row
    left = t.first[1:][row] - np.arange(len(row))  # tokens from here to the end of the row
    for j in range(1, k):
        on = np.flatnonzero(left > j)
        value[on] = chain(value[on], t.hash[on + j])
    keep = left >= k
    short = np.flatnonzero((n > 0) & (n < k))
    keep[t.first[short]] = True
    return value[keep], row[keep]
