"""Distinct counts with a state that is exact while it is small: an array, then a set of hashes, then registers.

One binary holds the state, its first byte the form:

    1  array: a byte for the number of hashes, hashes of eight bytes, little end first
    2  set: the number of hashes as a varint, hashes as before
    3  registers: 2**p of six bits each, from the low bits on; how many registers have each rank, four bytes each; how many
       are 0, two bytes

A hash's low p bits number its register, whose value is the largest rank: one more than the zeros at the low end of the
other bits. Hashes are kept in order and the form follows their number alone, so that states that have seen the same values
are equal byte for byte, however they were merged. The estimate from registers needs no tables of corrections: it sums over
the numbers of registers by rank, with series for the empty and the full ones (Ertl 2017, improved raw estimator)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import states

ARRAY, SET, REGISTERS = 1, 2, 3
#: Hashes of the form array at most.
FEW = 16


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (data[at] & 0x7F) << shift
        shift, at = shift + 7, at + 1
        if not data[at - 1] & 0x80:
            return n, at


def pack(registers: np.ndarray) -> bytes:
    """Six bits each: four registers in three bytes."""
    r = registers.reshape(-1, 4).astype(np.uint32)
    whole = r[:, 0] | r[:, 1] << 6 | r[:, 2] << 12 | r[:, 3] << 18
    return np.stack([whole & 255, whole >> 8 & 255, whole >> 16], 1).astype(np.uint8).tobytes()


def unpack(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.uint32)
    whole = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
    return np.stack([whole >> s & 63 for s in (0, 6, 12, 18)], 1).astype(np.uint8).ravel()


def trailing_zeros(x: np.ndarray) -> np.ndarray:
    """Of 64-bit numbers; 64 for 0."""
    low = x & (~x + np.uint64(1))
    return np.where(x == 0, 64, np.bitwise_count(low - np.uint64(1))).astype(np.int64)


def _sigma(x: float) -> float:
    if x == 1:
        return math.inf
    y, z = 1.0, x
    while True:
        x *= x
        before, z = z, z + x * y
        y += y
        if z == before:
            return z


def _tau(x: float) -> float:
    if x in (0.0, 1.0):
        return 0.0
    y, z = 1.0, 1 - x
    while True:
        x = math.sqrt(x)
        y *= 0.5
        before, z = z, z - (1 - x) ** 2 * y
        if z == before:
            return z / 3


def estimate_of(counts: np.ndarray, p: int) -> float:
    """From the number of registers of each rank, 0 to 65 - p."""
    m, most = 1 << p, 64 - p
    if counts[0] == m:
        return 0.0
    z = m * _tau(1 - counts[most + 1] / m)
    for k in range(most, 0, -1):
        z = 0.5 * (z + counts[k])
    z += m * _sigma(counts[0] / m)
    return m * m / (2 * math.log(2) * z)


@dataclass(frozen=True)
class Distinct:
    """p: there are 2**p registers, from 4 to 16. exact: hashes of a set at most; by default an eighth of what the registers
    take, 2**(p - 5)."""

    p: int = 12
    exact: int | None = None

    @property
    def limit(self) -> int:
        return max(FEW, 1 << max(self.p - 5, 0)) if self.exact is None else self.exact

    def _ranks(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << self.p, np.uint8)
        rank = np.minimum(trailing_zeros(hashes >> np.uint64(self.p)) + 1, 65 - self.p).astype(np.uint8)
        np.maximum.at(out, (hashes & np.uint64((1 << self.p) - 1)).astype(np.int64), rank)
        return out

    def _of_registers(self, registers: np.ndarray) -> bytes:
        counts = np.bincount(registers, minlength=66 - self.p).astype("<u4")
        return bytes([REGISTERS]) + pack(registers) + counts.tobytes() + int(counts[0]).to_bytes(4, "little")[:2]

    def _of_hashes(self, hashes: np.ndarray) -> bytes:
        """hashes: in order, each once."""
        if len(hashes) > self.limit:
            return self._of_registers(self._ranks(hashes))
        lead = bytes([ARRAY, len(hashes)]) if len(hashes) <= FEW else bytes([SET]) + _varint(len(hashes))
        return lead + hashes.astype("<u8").tobytes()

    def of(self, values: pa.Array) -> bytes:
        """values: hashes as 64-bit integers."""
        return self._of_hashes(np.unique(values.to_numpy().view(np.uint64)))

    def hashes(self, state: bytes) -> np.ndarray | None:
        """Those of an array or a set; None for registers."""
        if state[0] == REGISTERS:
            return None
        if state[0] not in (ARRAY, SET):
            raise ValueError(f"no such form of state: {state[0]}")
        n, at = (state[1], 2) if state[0] == ARRAY else _read_varint(state, 1)
        return np.frombuffer(state, "<u8", n, at)

    def registers(self, state: bytes) -> np.ndarray:
        hashes = self.hashes(state)
        return self._ranks(hashes) if hashes is not None else unpack(state[1 : 1 + (6 << self.p) // 8])

    def merge(self, parts: list[bytes]) -> bytes:
        small = [h for s in parts if (h := self.hashes(s)) is not None]
        rows = [self.registers(s) for s in parts if s[0] == REGISTERS]
        hashes = np.unique(np.concatenate([np.zeros(0, np.uint64), *small]))
        if not rows:
            return self._of_hashes(hashes)
        return self._of_registers(np.maximum.reduce([*rows, self._ranks(hashes)]))

    def count(self, state: bytes) -> float:
        hashes = self.hashes(state)
        if hashes is not None:
            return float(len(hashes))
        at = 1 + (6 << self.p) // 8
        return estimate_of(np.frombuffer(state, "<u4", 66 - self.p, at), self.p)


def hashed(value: str | Column) -> Column:
    """The hash that states are made of; nulls and empty texts have none and are not counted."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(c.isNotNull() & (c.cast("string") != ""), F.xxhash64(c))


def distinct_states(df: DataFrame, keys: list[str], value: str, sketch: Distinct = Distinct()) -> DataFrame:
    return states.states(df.select(*keys, hashed(value).alias("hash")), keys, "hash", sketch)


def counted(df: DataFrame, sketch: Distinct = Distinct(), state: str = "state", name: str = "approx_distinct") -> DataFrame:
    """df with the count of each state, rounded to a whole number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [None if s is None else round(sketch.count(s)) for s in b.column(state).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=[*b.schema.names, name])

    return df.mapInArrow(run, df.withColumn(name, F.lit(0).cast("long")).schema)
