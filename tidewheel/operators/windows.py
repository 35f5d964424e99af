"""Time windows, count windows and ranks inside windows, over batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .names import fresh


def time_window(df: DataFrame, size: str, aggregates: list[Column], keys: list[str] | None = None, slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Aggregates by window [win_start, win_end) and keys. Sums and counts are combined before the shuffle."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    got = df.groupBy(window.alias("w"), *(keys or [])).agg(*aggregates)
    return got.select(F.col("w.start").alias("win_start"), F.col("w.end").alias("win_end"), *[c for c in got.columns if c != "w"])


def processing_time_window(df: DataFrame, size: str, aggregates: list[Column], keys: list[str] | None = None, slide: str | None = None) -> DataFrame:
    """time_window over the time at which rows are worked on: all rows of a batch, or of a micro-batch, have one."""
    (now,) = fresh(df.columns, "now")
    return time_window(df.withColumn(now, F.current_timestamp()), size, aggregates, keys, slide, now)


def top_n(df: DataFrame, n: int, within: list[str], order: list[Column], rank: str = "rnk") -> DataFrame:
    """The first n rows of each group; Spark keeps n rows of each group per task before it shuffles."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col(rank) <= n)


def count_window(df: DataFrame, key: str, order: list[str], size: int, aggregates: list[Column]) -> DataFrame:
    """Aggregates over each size rows of a key, in order; what does not fill a window is not returned."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    win = F.floor((number - 1) / size).cast("long")
    return df.withColumn("win", win).groupBy(key, "win").agg(F.count("*").alias("__n"), *aggregates).where(F.col("__n") == size).drop("__n")


def sliding_count_window(df: DataFrame, key: str, order: list[str], size: int, slide: int, aggregates: dict[str, Column]) -> DataFrame:
    """On every slide-th row of a key, aggregates over its last size rows at most. Returns key, rn and the aggregates."""
    by = Window.partitionBy(key).orderBy(*order)
    frame = by.rowsBetween(-(size - 1), 0)
    rows = df.select(key, F.row_number().over(by).cast("long").alias("rn"), *[a.over(frame).alias(n) for n, a in aggregates.items()])
    return rows.where(F.col("rn") % slide == 0)


def running(df: DataFrame, order: str, value: Column, name: str, pick: str = "max", block: int = 1 << 16, keys: list[str] | None = None) -> DataFrame:
    """pick ('max' or 'sum') of value over all rows before each one in the order of a whole-number column; keys: over those
    of equal keys, which are not null.

    A frame over the whole table, or over a hot key, would bring it to one task. Here rows of a block of the order are one
    group, and only one value for each block goes through the frame that spans blocks."""
    agg, keys = F.max if pick == "max" else F.sum, keys or []
    v, b, t, mine, earlier = fresh(df.columns, "v", "b", "t", "own", "before")
    rows = df.withColumn(v, value).withColumn(b, F.floor(F.col(order) / block))
    blocks = rows.groupBy(*keys, b).agg(agg(v).alias(t))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, b, agg(t).over(before).alias(earlier))
    inside = Window.partitionBy(*keys, b).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumn(mine, agg(v).over(inside)).join(blocks, [*keys, b])
    both = F.greatest(earlier, mine) if pick == "max" else F.coalesce(F.col(earlier) + F.col(mine), earlier, mine)
    return joined.withColumn(name, both).drop(v, b, mine, earlier)
