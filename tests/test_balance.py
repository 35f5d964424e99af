"""Heavy keys by counters, and rows by task when salts are measured."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import balance
from tidewheel.session import shared_dir


def zipf(n, exponent=1.1, seed=1):
    rng = np.random.default_rng(seed)
    return np.minimum(rng.zipf(exponent, n), 10**9)


def test_counters_miss_little_and_merge():
    values = zipf(60_000)
    c = balance.Counters(50)
    parts = [c.of(pa.array(values[i::7])) for i in range(7)]
    for merged in (c.merge(parts), c.merge([c.merge(parts[:3]), *parts[3:]])):
        numbers, counts = c.read(merged)
        assert len(numbers) <= 50
        held = dict(zip(numbers.tolist(), counts.tolist(), strict=True))
        true, n = np.unique(values, return_counts=True)
        for v, k in zip(true.tolist(), n.tolist(), strict=True):
            assert k - len(values) / 50 <= held.get(v, 0) <= k


def by_task(df, tasks, *columns):
    return [r["count"] for r in df.repartition(tasks, *columns).groupBy(F.spark_partition_id()).count().collect()]


@pytest.mark.parametrize("share", [0.34, 0.9])
def test_tasks_are_even_on_a_skewed_table(spark, share):
    """A third or nine tenths of the rows have one key, the others follow a steep law."""
    n, tasks = 200_000, 16
    rest = spark.createDataFrame(pa.table({"k": zipf(int(n * (1 - share)))}).to_pandas())
    df = spark.range(int(n * share)).select(F.lit(-1).cast("long").alias("k")).unionByName(rest).withColumn("id", F.monotonically_increasing_id())
    df.write.parquet(path := shared_dir(spark, "balance-test"))
    df = spark.read.parquet(path)
    plain = by_task(df, tasks, "k")
    plan = balance.measure(df, ["k"], tasks)
    even = by_task(plan.salted(df, "id"), tasks, "k", "salt")
    assert max(plain) > 3 * n / tasks and sum(even) == df.count() and max(even) <= 1.5 * sum(even) / tasks


def test_balanced_joins_and_aggregates(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("k"))
    left = left.unionByName(spark.createDataFrame([(5000, None)], "id long, k string"))
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("7", 3), ("none", 4), (None, 5)], "k string, v int")
    plan = balance.measure(left, ["k"], 8)
    assert len(max(plan.salts.values(), key=len)) > 4
    for how in ("inner", "left", "leftsemi", "leftanti"):
        assert sorted(map(str, balance.join(left, right, plan, ["id"], how).collect())) == sorted(map(str, left.join(right, "k", how).collect()))
    with pytest.raises(ValueError):
        balance.join(left, right, plan, ["id"], "full")
    got = balance.aggregate(left, plan, ["id"], [F.count("*").alias("n")], [F.sum("n").alias("n")])
    assert sorted(map(str, got.collect())) == sorted(map(str, left.groupBy("k").agg(F.count("*").alias("n")).collect()))
    none = balance.measure(left.limit(0), ["k"], 8)
    assert none.salts == {} and balance.aggregate(left, none, ["id"], [F.count("*").alias("n")], [F.sum("n").alias("n")]).count() == 52
