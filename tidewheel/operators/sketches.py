"""Spark's own sketches: distinct counts whose states merge, and bitmaps of fixed size. See distinct.py, quantiles.py and
bitmaps.py for states of stated form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hll_states(df: DataFrame, keys: list[Column], value: str, lg_k: int = 12) -> DataFrame:
    """A state for each group, to be kept and merged later."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(value, lg_k).alias("state"))


def hll_merge(states: DataFrame, keys: list[Column]) -> DataFrame:
    return states.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("state")).alias("approx_distinct"))


def bitmaps(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Bitmaps of whole numbers: one of fixed size for each group and range of values."""
    return df.groupBy(*keys, F.bitmap_bucket_number(value).alias("bitmap")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits"))


def bitmap_merge(maps: DataFrame, keys: list[str], how: str = "or") -> DataFrame:
    """Unions (or) of the bitmaps of each group, counted: keys, distinct_values."""
    merge = F.bitmap_or_agg if how == "or" else F.bitmap_and_agg
    return maps.groupBy(*keys, "bitmap").agg(merge("bits").alias("bits")).groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias("distinct_values"))
