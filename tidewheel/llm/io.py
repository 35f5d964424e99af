"""The folder that driver and executors share, and the memory of Python processes."""

from __future__ import annotations

import ctypes
import re

import pyarrow as pa
from pyspark.sql import SparkSession

from ..session import shared_dir

__all__ = ["fresh_names", "give_back", "shared_dir", "small_batches"]


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Lowers the session's limit of bytes that go to a Python worker at once to most, if it is larger: texts differ so
    much in size that a limit by rows bounds no memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)b?", spark.conf.get(name).strip().lower()).groups()
    limit = int(number) << 10 * " kmgtp".index(unit or " ")
    if limit <= 0 or limit > most:
        spark.conf.set(name, f"{most}b")


def give_back() -> None:
    """Memory that has been freed goes back to the machine, as a worker's process lives on, and the driver's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def fresh_names(taken: list[str], *wished: str) -> list[str]:
    """Names for helper columns that meet none of a table's columns, whatever their case, and not each other."""
    had, out = {c.lower() for c in taken}, []
    for name in wished:
        name = f"_{name}"
        while name.lower() in had:
            name += "_"
        had.add(name.lower())
        out.append(name)
    return out
