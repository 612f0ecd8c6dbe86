"""Content-defined cells of a byte buffer: which windows can be repeated anywhere is decided by one anchor for each cell.

The anchor of a window is the block of ANCHOR bytes in it with the least hash, so windows of equal bytes have anchors of
equal bytes at the same distance. Neighbouring windows with one anchor form a cell.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from sylvan.llm.hashing import BASE, INVERSE, mix, powers

PIECE = 1 << 17


def rolling(data: np.ndarray, length: int) -> np.ndarray:
    """Mixed hashes of all runs of `length` bytes."""
    n = len(data) - length + 1
    out = np.empty(max(n, 0), np.uint64)
    up, down = powers(BASE, PIECE + length), powers(INVERSE, PIECE)
    for a in range(0, n, PIECE):
        b = min(n, a + PIECE)
        sums = np.zeros(b - a + length, np.uint64)
        np.cumsum((data[a : b + length - 1].astype(np.uint64) + np.uint64(1)) * up[: b - a + length - 1], out=sums[1:])
        out[a:b] = mix((sums[length:] - sums[: b - a]) * down[: b - a])
    return out


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values."""
    n = len(h) - width + 1
    out = np.empty(max(n, 0), h.dtype)
    for a in range(0, n, PIECE):
        b = min(n, a + PIECE)
        m, size = h[a : b + width - 1], 1
        while 2 * size <= width:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        rest = width - size
        out[a:b] = np.minimum(m[: len(m) - rest], m[rest:]) if rest else m
    return out


class Cells(NamedTuple):
    """Cells in order: first and last window, anchor, and the anchor's hash."""

    low: np.ndarray
    high: np.ndarray
    anchor: np.ndarray
    hash: np.ndarray


#: Windows that are looked at together; what a block holds beside its text grows with this only.
SEGMENT = 1 << 19


def cells(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> Cells:
    """Cells of the windows of `length` bytes that lie inside one text. A cell may also end where a segment does."""
    parts = [segment_cells(data, offsets, a, min(len(data) - length + 1, a + SEGMENT), length, anchor) for a in range(0, len(data) - length + 1, SEGMENT)]
    if not parts:
        return Cells(*(np.empty(0, np.int64),) * 3, np.empty(0, np.uint64))
    return Cells(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def segment_cells(data: np.ndarray, offsets: np.ndarray, first: int, last: int, length: int, anchor: int) -> Cells:
    """Cells of the windows that start in first .. last - 1."""
    width = length - anchor + 1
    h = rolling(data[first : last + length - 1], anchor)
    m = least(h, width)
    # Windows that begin in a text's last length - 1 bytes reach into the next one.
    step = np.zeros(len(m) + 1, np.int32)
    begin = np.clip(offsets[:-1] - first, 0, len(m))
    end = np.maximum(begin, np.clip(offsets[1:] - length + 1 - first, 0, len(m)))
    np.add.at(step, begin, 1)
    np.subtract.at(step, end, 1)
    valid = np.cumsum(step[:-1]) > 0
    starts = valid.copy()
    # A cell goes on where the least hash stays and its place is still inside.
    starts[1:] &= ~(valid[:-1] & (m[1:] == m[:-1]) & (h[: len(m) - 1] != m[:-1]))
    low = np.flatnonzero(starts)
    stops = np.flatnonzero(valid & ~np.append(valid[1:] & ~starts[1:], False))
    place = low.copy()
    todo = np.arange(len(low))
    best = m[low]
    # The first place in the window with that hash; cells are short, so few steps are needed for all but some.
    k = 0
    while len(todo) and k < width:
        todo = todo[h[place[todo]] != best[todo]]
        place[todo] += 1
        k += 1
    # The least of many hashes is small: mixed once more, anchors fall evenly into buckets.
    return Cells(low + first, stops + first, place + first, mix(best))
