"""Terms of a column of texts: runs of ASCII letters and of characters beyond ASCII, A to Z as a to z, over UTF-8 bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .words import column_bytes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True


@dataclass
class Terms:
    """data: the bytes, lower-cased; offsets: where texts begin; start, end: of terms; bounds: text i has terms bounds[i] to
    bounds[i+1]; letters: the terms' bytes, one after the other."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    letters: np.ndarray

    def doc(self) -> np.ndarray:
        """Of each term, the row of its text."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.bounds))

    def strings(self) -> pa.Array:
        ends = np.zeros(len(self.start) + 1, np.int64)
        np.cumsum(self.end - self.start, out=ends[1:])
        return pa.LargeStringArray.from_buffers(len(self.start), pa.py_buffer(ends), pa.py_buffer(self.letters))


def terms_of(column: pa.Array) -> Terms:
    offsets, data = column_bytes(column)
    data = _LOWER[data]
    inside = _INSIDE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Terms(data, offsets, start, end, np.searchsorted(start, offsets), data[inside])
