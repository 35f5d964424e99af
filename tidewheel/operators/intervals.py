"""Intervals: splitting into buckets, merging, overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.granularity import Granularity, from_micros, micros


def split(df: DataFrame, start: Column, end: Column, unit: str, name: str = "bucket") -> DataFrame:
    """A row for each bucket of a calendar unit that [start, end) touches; the first may begin before start. An empty
    interval has none."""
    first = F.date_trunc(unit, start)
    step = F.expr(f"INTERVAL '1' {unit}")
    last = F.date_trunc(unit, end - F.expr("INTERVAL '0.000001' SECOND"))
    return df.where(start < end).withColumn(name, F.explode(F.sequence(first, last, step)))


def split_by(df: DataFrame, start: Column, end: Column, granularity: Granularity, name: str = "bucket") -> DataFrame:
    """A row for each bucket of a granularity that [start, end) touches; the first may begin before start."""
    rows = df.where(start < end)
    end = end - F.expr("INTERVAL '0.000001' SECOND")
    if granularity.kind == "all":
        return rows.withColumn(name, granularity.floor(start))
    if granularity.kind == "none":
        raise ValueError("intervals are not split to the millisecond")
    if granularity.months:
        # numbers of buckets: a bucket's start is worked out once, where it is put out
        numbers = F.sequence(granularity.number(start), granularity.number(end))
        return rows.withColumn(name, F.explode(numbers)).withColumn(name, granularity.start_of(F.col(name)))
    starts = F.sequence(micros(granularity.floor(start)), micros(granularity.floor(end)), F.lit(granularity.us).cast("long"))
    return rows.withColumn(name, F.explode(F.transform(starts, from_micros)))


def condense(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Overlapping and abutting intervals of each key as one: keys, start, end."""
    by = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    # equal intervals count together, so it does not matter which of them came first
    numbered = marked.withColumn("__island", F.sum("__new").over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def has_overlap(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Of each key: whether any two of its intervals overlap (abutting ones do not), and the interval that covers all."""
    by = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__hit", F.coalesce(F.col(start) < before, F.lit(False)))
    return marked.groupBy(*keys).agg(F.bool_or("__hit").alias("overlaps"), F.min(start).alias("umbrella_start"), F.max(end).alias("umbrella_end"))
