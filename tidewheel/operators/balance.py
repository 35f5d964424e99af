"""Keys balanced by what is measured: heavy keys are found by counters, cut into as many parts as they need, and each part gets
a salt that makes Spark's hash partitioning put it on another task.

Counters are kept for some keys at a time (Misra and Gries); summaries of tasks merge, and what they miss of a key is no more
than the rows over the number of counters. A key of more than a part's share of the rows is heavy; there are no more such keys
than parts, so the plan is a few numbers for each task, whatever the data. Salts are searched on the driver: of the first ones of a
key those are taken that fall on the tasks with the least rows so far."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import states

SALT = "salt"


@dataclass(frozen=True)
class Counters:
    """Counts of whole numbers: most of them at a time. A state is pairs of number and count, eight bytes each."""

    most: int

    def _state(self, numbers: np.ndarray, counts: np.ndarray) -> bytes:
        if len(numbers) > self.most:
            counts = counts - np.partition(counts, -self.most - 1)[-self.most - 1]
            numbers, counts = numbers[counts > 0], counts[counts > 0]
        return np.stack([numbers, counts]).astype("<i8").tobytes()

    def read(self, state: bytes) -> tuple[np.ndarray, np.ndarray]:
        numbers, counts = np.frombuffer(state, "<i8").reshape(2, -1)
        return numbers, counts

    def of(self, values: pa.Array) -> bytes:
        return self._state(*np.unique(values.to_numpy(), return_counts=True))

    def merge(self, parts: list[bytes]) -> bytes:
        numbers, counts = (np.concatenate(x) for x in zip(*map(self.read, parts), strict=True))
        numbers, place = np.unique(numbers, return_inverse=True)
        sums = np.zeros(len(numbers), np.int64)
        np.add.at(sums, place, counts)
        return self._state(numbers, sums)


@dataclass(frozen=True)
class Plan:
    """salts: of each heavy key, by its hash, the salts of its parts; other keys have the salt 0. rows: by task, of heavy keys."""

    keys: list[str]
    tasks: int
    salts: dict[int, list[int]]
    rows: list[float]

    def _table(self, df: DataFrame) -> DataFrame:
        rows = [(h, s) for h, s in self.salts.items()]
        return F.broadcast(df.sparkSession.createDataFrame(rows, "_heavy long, _salts array<int>"))  # as many rows as parts at most

    def salted(self, df: DataFrame, *spread: str) -> DataFrame:
        """df with a salt: rows of a heavy key are dealt over its parts by the values of spread."""
        joined = df.join(self._table(df), F.xxhash64(*self.keys) == F.col("_heavy"), "left")
        part = F.pmod(F.xxhash64(*spread), F.size("_salts")).cast("int")
        return joined.withColumn(SALT, F.coalesce(F.get("_salts", part), F.lit(0))).drop("_heavy", "_salts")

    def copied(self, df: DataFrame) -> DataFrame:
        """df with a row for each part of its key, for the other side of a join."""
        joined = df.join(self._table(df), F.xxhash64(*self.keys) == F.col("_heavy"), "left")
        return joined.withColumn(SALT, F.explode(F.coalesce("_salts", F.array(F.lit(0))))).drop("_heavy", "_salts")


def measure(df: DataFrame, keys: list[str], tasks: int, part: float = 0.25) -> Plan:
    """Finds df's heavy keys, of more than part of a task's mean rows, and salts for tasks of groupBy or join by keys and salt."""
    spark = df.sparkSession
    hashed = df.select(F.xxhash64(*keys).alias("h"), F.struct(*keys).alias("k"))
    counters = Counters(math.ceil(4 * tasks / part))
    state = None
    for r in states.states(hashed.select((F.pmod("h", F.lit(16))).alias("sixteenth"), "h"), ["sixteenth"], "h", counters).collect():
        state = r.state if state is None else counters.merge([state, r.state])
    total = df.count()
    if state is None or not total:
        return Plan(keys, tasks, {}, [0.0] * tasks)
    numbers, counts = counters.read(state)
    share = total * part / tasks
    # what the counters may have missed is no more than a quarter of a part
    heavy = {int(h): int(n) for h, n in zip(numbers, counts, strict=True) if n + share / 4 >= share}
    wanted = {h: math.ceil((n + share / 4) / share) for h, n in heavy.items()}
    table = F.broadcast(spark.createDataFrame(list(wanted.items()), "h long, n int"))
    values = hashed.join(table, "h").groupBy("h").agg(F.first("k").alias("k"), F.first("n").alias("n")) if wanted else None
    tried = []
    if values is not None:
        salts = values.select("h", "k", F.explode(F.sequence(F.lit(1), 8 * F.col("n"))).alias(SALT))
        tried = salts.select("h", SALT, F.pmod(F.hash(*[F.col(f"k.{k}") for k in keys], F.col(SALT)), F.lit(tasks)).alias("task")).collect()
    first: dict[int, dict[int, int]] = {}
    for r in sorted(tried, key=lambda r: r[SALT]):
        first.setdefault(r.h, {}).setdefault(r.task, r[SALT])
    rows, chosen = [0.0] * tasks, {}
    for h, n in sorted(heavy.items(), key=lambda x: (-x[1], x[0])):
        picked = sorted(first[h], key=lambda t: (rows[t], t))[: wanted[h]]
        for t in picked:
            rows[t] += n / len(picked)
        chosen[h] = [first[h][t] for t in picked]
    return Plan(keys, tasks, chosen, rows)


def aggregate(df: DataFrame, plan: Plan, spread: list[str], first: list[Column], then: list[Column]) -> DataFrame:
    """Aggregates by keys and salt, and those by keys."""
    return plan.salted(df, *spread).groupBy(*plan.keys, SALT).agg(*first).groupBy(*plan.keys).agg(*then)


def join(left: DataFrame, right: DataFrame, plan: Plan, spread: list[str], how: str = "inner") -> DataFrame:
    """left's heavy keys in parts, right's rows of them once for each part; how: inner, left, leftsemi or leftanti."""
    if how not in ("inner", "left", "leftsemi", "leftanti"):
        raise ValueError(f"rows of the right side stand more than once in a {how} join")
    return plan.salted(left, *spread).join(plan.copied(right), [*plan.keys, SALT], how).drop(SALT)
