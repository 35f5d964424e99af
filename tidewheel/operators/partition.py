"""How rows are dealt over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rebalance(df: DataFrame, n: int) -> DataFrame:
    """Rows dealt over n tasks in turn."""
    return df.repartition(n)


def shuffle(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """Rows dealt over n tasks at random; with a seed, alike for equal input partitions."""
    return df.repartition(n, F.rand(seed) if seed is not None else F.rand())


def by_key(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows of equal keys in one task of n."""
    return df.repartition(n, *keys)


def task_ids(df: DataFrame, name: str = "id", start: int = 0) -> DataFrame:
    """df with ids that no two rows share, which each task gives without asking others: its number plus start, then on by the
    number of tasks. A task that runs again gives its rows the same ids if it reads them in the same order."""
    tasks = df.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return df.withColumn(name, place * ((tasks or 0) + 1) + F.spark_partition_id() + start)
