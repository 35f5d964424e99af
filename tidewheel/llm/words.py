"""Words, spans and hashes of a column of texts, as numpy arrays over its UTF-8 bytes.

A word is a run of bytes other than space and tab to carriage return. These separators are ASCII, so the bytes of a
text can be cut without decoding them. Nothing here keeps more than a few times the bytes of one slice of a batch; a
single text longer than a slice is hashed block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Text of so many bytes is worked on at once.
SLICE_BYTES = 4 << 20
BLOCK = 1 << 20

INSIDE = np.ones(256, bool)
INSIDE[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply): near values become unrelated ones."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_UNBASE = pow(_BASE, -1, 1 << 64)
_BYTE2 = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_BASE2 = 0x2545F4914F6CDD1D
_UNBASE2 = pow(_BASE2, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n-1, modulo 2**64."""
    had = _POWERS.get(base)
    if had is None or len(had) < n:
        steps = np.full(max(n, BLOCK + 1), base, U64)
        steps[0] = 1
        had = _POWERS[base] = np.cumprod(steps, dtype=U64)
    return had[:n]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows, from 0) and UTF-8 bytes of a column of strings; a null is an empty text."""
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have limit bytes at most, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets, _ = column_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; the spans are in order and do not overlap. second: another one, of other
    values for the bytes and another base."""
    byte, base, unbase = (_BYTE2, _BASE2, _UNBASE2) if second else (_BYTE, _BASE, _UNBASE)
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        part = byte[data[low : int(ends[j - 1])]]
        part *= _powers(base, len(part))
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(part, out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[e] - sums[s]) * _powers(unbase, len(part) + 1)[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


@dataclass
class Words:
    """data: the bytes; offsets: where texts begin; start, end: of words; bounds: text i has words bounds[i] to bounds[i+1]."""

    data: np.ndarray
    offsets: np.ndarray
    inside: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def doc(self) -> np.ndarray:
        """Of each word, the row of its text."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def left(self) -> np.ndarray:
        """Of each word, how many words its text has from there on."""
        return np.repeat(self.bounds[1:], self.counts) - np.arange(len(self.start))

    def hashes(self, second: bool = False) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end, second)


def words_of(column: pa.Array, lower: bool = False) -> Words:
    """lower: A to Z count as a to z."""
    offsets, data = column_bytes(column)
    if lower:
        table = np.arange(256, dtype=np.uint8)
        table[65:91] += 32
        data = table[data]
    inside = INSIDE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, offsets, inside, start, end, np.searchsorted(start, offsets))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each window of k hashes, one for each place but the last k - 1; the order within a window counts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= U64(0xA0761D6478BD642F)
        out += hashes[j : j + n]
    return mix(out)


def doubled(names: np.ndarray, k: int) -> np.ndarray:
    """From the names of windows of k words, those of windows of 2 k words."""
    if len(names) <= k:
        return np.zeros(0, U64)
    return mix(names[:-k] * U64(0xE7037ED1A0B428DB) + names[k:])


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values from bounds[i] to bounds[i+1]."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def lines_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines between newlines, and bounds of the lines of each text; every text has a line."""
    newline = np.flatnonzero(words.data == 10)
    starts = np.sort(np.concatenate([words.offsets[:-1], newline + 1]), kind="stable")
    n = np.diff(np.searchsorted(newline, words.offsets)) + 1
    bounds = np.concatenate([[0], np.cumsum(n)])
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[bounds[1:] - 1] = words.offsets[1:]
    return starts, ends, bounds
