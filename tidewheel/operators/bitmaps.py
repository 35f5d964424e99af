"""Sets of numbers below 2**32 as compressed bitmaps in the portable form of roaring bitmaps.

Numbers are held by their high 16 bits in containers of the low ones: a sorted array of up to 4,096 numbers, a bitmap of 8 KB,
or runs of (first, length - 1), whichever is smallest. A header names the containers and their sizes, so the cardinality is
read without them. Each set has one such form, so that equal sets are equal byte for byte, however they were merged."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import states

#: Fixed values of the portable form: cookies without and with runs, and from how many containers on offsets follow the runs.
PLAIN, WITH_RUNS, OFFSETS_FROM = 12346, 12347, 4
MOST = 4096
SPACE = 1 << 16


def _runs(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First numbers and lengths of the runs of a sorted array."""
    cut = np.flatnonzero(np.diff(low.astype(np.int64)) != 1) + 1
    first = np.concatenate([[0], cut])
    return low[first], np.diff(np.concatenate([first, [len(low)]]))


def _container(low: np.ndarray) -> tuple[bool, bytes]:
    """Whether it is of runs, and its bytes; low: sorted numbers, each once, at least one."""
    start, length = _runs(low)
    plain = 2 * len(low) if len(low) <= MOST else SPACE // 8
    if 2 + 4 * len(start) < plain:
        pairs = np.stack([start.astype(np.uint16), (length - 1).astype(np.uint16)], 1)
        return True, struct.pack("<H", len(start)) + pairs.astype("<u2").tobytes()
    if len(low) <= MOST:
        return False, low.astype("<u2").tobytes()
    bits = np.zeros(SPACE, np.uint8)
    bits[low] = 1
    return False, np.packbits(bits, bitorder="little").tobytes()


def dump(containers: dict[int, np.ndarray]) -> bytes:
    """The portable form of sorted low numbers by high number; empty containers are left out."""
    high = sorted(h for h, low in containers.items() if len(low))
    made = [_container(containers[h]) for h in high]
    with_runs = any(r for r, _ in made)
    if with_runs:
        flags = np.packbits(np.array([r for r, _ in made], np.uint8), bitorder="little").tobytes()
        lead = struct.pack("<I", WITH_RUNS | len(high) - 1 << 16) + flags
    else:
        lead = struct.pack("<II", PLAIN, len(high))
    sizes = np.array([[h, len(containers[h]) - 1] for h in high], "<u2").tobytes()
    out = lead + sizes
    if not with_runs or len(high) >= OFFSETS_FROM:
        at = len(out) + 4 * len(high)
        ends = np.cumsum([at, *[len(b) for _, b in made]])[:-1] if made else []
        out += np.array(ends, "<u4").tobytes()
    return out + b"".join(b for _, b in made)


def _header(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """High numbers, cardinalities, which are of runs, and where the containers begin."""
    cookie = struct.unpack_from("<I", data)[0]
    if cookie & 0xFFFF == WITH_RUNS:
        n, at = (cookie >> 16) + 1, 4
        runs = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), bitorder="little")[:n].astype(bool)
        at += (n + 7) // 8
    elif cookie == PLAIN:
        n, at = struct.unpack_from("<I", data, 4)[0], 8
        runs = np.zeros(n, bool)
    else:
        raise ValueError(f"no bitmap begins with {cookie}")
    both = np.frombuffer(data, "<u2", 2 * n, at).reshape(-1, 2).astype(np.int64)
    at += 4 * n
    if cookie == PLAIN or n >= OFFSETS_FROM:
        at += 4 * n
    return both[:, 0], both[:, 1] + 1, runs, at


def load(data: bytes) -> dict[int, np.ndarray]:
    high, sizes, runs, at = _header(data)
    out = {}
    for h, n, of_runs in zip(high.tolist(), sizes.tolist(), runs.tolist(), strict=True):
        if of_runs:
            k = struct.unpack_from("<H", data, at)[0]
            pairs = np.frombuffer(data, "<u2", 2 * k, at + 2).reshape(-1, 2).astype(np.int64)
            length = pairs[:, 1] + 1
            before = np.cumsum(length) - length
            low = np.repeat(pairs[:, 0] - before, length) + np.arange(length.sum())
            at += 2 + 4 * k
        elif n <= MOST:
            low = np.frombuffer(data, "<u2", n, at)
            at += 2 * n
        else:
            low = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, SPACE // 8, at), bitorder="little"))
            at += SPACE // 8
        out[h] = low.astype(np.uint16)
    return out


def cardinality(data: bytes) -> int:
    return int(_header(data)[1].sum())


def _split(values: np.ndarray) -> dict[int, np.ndarray]:
    high = (values >> 16).astype(np.int64)
    cuts = np.flatnonzero(np.diff(high, prepend=-1, append=-1))
    return {int(high[a]): (values[a:b] & 0xFFFF).astype(np.uint16) for a, b in zip(cuts[:-1], cuts[1:], strict=True)}


def both(parts: list[bytes]) -> bytes:
    """The numbers that are in all."""
    sets = [load(p) for p in parts]
    out = sets[0]
    for other in sets[1:]:
        out = {h: np.intersect1d(low, other[h], assume_unique=True) for h, low in out.items() if h in other}
    return dump(out)


@dataclass(frozen=True)
class Bitmap:
    """Unions of sets. intersect: what is in all states instead."""

    intersect: bool = False

    def of(self, values: pa.Array) -> bytes:
        numbers = np.unique(values.to_numpy())
        if len(numbers) and not 0 <= numbers[0] <= numbers[-1] < 1 << 32:
            raise ValueError("bitmaps take numbers from 0 to 2**32 - 1")
        return dump(_split(numbers))

    def merge(self, parts: list[bytes]) -> bytes:
        if self.intersect:
            return both(parts)
        held: dict[int, list[np.ndarray]] = {}
        for p in parts:
            for h, low in load(p).items():
                held.setdefault(h, []).append(low)
        return dump({h: lows[0] if len(lows) == 1 else np.unique(np.concatenate(lows)) for h, lows in held.items()})


def bitmaps(df: DataFrame, keys: list[str], value: str, name: str = "bitmap") -> DataFrame:
    """keys, bitmap of the numbers of each group."""
    return states.states(df.select(*keys, F.col(value).cast("long").alias(value)), keys, value, Bitmap(), name)


def counted(df: DataFrame, bitmap: str = "bitmap", name: str = "distinct_values") -> DataFrame:
    """df with the cardinality of each bitmap, from its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [None if s is None else cardinality(s) for s in b.column(bitmap).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=[*b.schema.names, name])

    return df.mapInArrow(run, df.withColumn(name, F.lit(0).cast("long")).schema)
