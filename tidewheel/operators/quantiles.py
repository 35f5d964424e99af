"""Quantiles of bounded relative error, of numbers of any sign, from states that merge.

Bin i of a sign counts the numbers whose size is from gamma**(i - 1) to gamma**i; zeros are counted apart. A state is an array
of (sign, place, n) in the order of values, with the smallest and the largest number. Of a sign the most bins from its highest
down are kept; the lower ones (the sizes next to 0) fall together in the lowest of these, whatever the order of merges:
quantiles that end in that bin lose their bound. Nulls and what is no number are not counted; infinite numbers count as the largest ones."""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _gamma(accuracy: float) -> float:
    return (1 + accuracy) / (1 - accuracy)


def _packed(counts: DataFrame, keys: list[str], most: int) -> DataFrame:
    """States from rows of keys, sign, bin, n, low, high, one for each bin."""
    each = F.struct("sign", (F.col("sign") * F.col("bin")).alias("place"), "n")
    whole = counts.groupBy(*keys).agg(F.collect_list(each).alias("bins"), F.min("low").alias("low"), F.max("high").alias("high"))
    bins = F.sort_array(F.concat(*[_bounded(sign, most) for sign in (-1, 0, 1)]))
    return whole.select(*keys, bins.alias("bins"), "low", "high")


def _bounded(sign: int, most: int) -> Column:
    """The bins of one sign, of which those below the most highest fall together in the lowest of these."""
    bins = F.filter("bins", lambda b: b["sign"] == sign)
    lowest = F.array_max(F.transform(bins, lambda b: b["place"] * sign)) - (most - 1)
    total = F.aggregate(F.filter(bins, lambda b: b["place"] * sign <= lowest), F.lit(0).cast("long"), lambda upto, b: upto + b["n"])
    rest = F.struct(F.lit(sign).alias("sign"), (lowest * sign).alias("place"), total.alias("n"))
    return F.when(F.exists(bins, lambda b: b["place"] * sign < lowest), F.concat(F.filter(bins, lambda b: b["place"] * sign > lowest), F.array(rest))).otherwise(bins)


def quantile_states(df: DataFrame, keys: list[str], value: str, accuracy: float = 0.01, most: int = 2048) -> DataFrame:
    """keys, bins, low, high of each group; most: bins of a sign. Counts are combined before the shuffle."""
    v = F.greatest(F.least(F.col(value).cast("double"), F.lit(sys.float_info.max)), F.lit(-sys.float_info.max))
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, v.alias("v"))
    size = F.ceil(F.log(F.abs("v")) / F.lit(math.log(_gamma(accuracy)))).cast("int")
    rows = rows.select(*keys, F.signum("v").cast("int").alias("sign"), F.when(F.col("v") == 0, 0).otherwise(size).alias("bin"), "v")
    counts = rows.groupBy(*keys, "sign", "bin").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    return _packed(counts, keys, most)


def merge_quantiles(states: DataFrame, keys: list[str], most: int = 2048) -> DataFrame:
    """States of larger groups; without keys one of all."""
    rows = states.select(*keys, "low", "high", F.inline("bins")).withColumn("bin", F.col("sign") * F.col("place"))
    return _packed(rows.groupBy(*keys, "sign", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")), keys, most)


def quantile(q: float, accuracy: float = 0.01) -> Column:
    """Of a state's columns, the value of the bin that holds the number of rank floor(q * (n - 1)), no further out than the
    smallest or largest number."""
    gamma = _gamma(accuracy)
    total = F.aggregate("bins", F.lit(0).cast("long"), lambda upto, b: upto + b["n"])
    rank = F.floor(F.lit(q) * (total - 1))
    start = F.struct(rank.alias("left"), F.lit(None).cast("int").alias("sign"), F.lit(None).cast("int").alias("place"))

    def step(at: Column, b: Column) -> Column:
        found = at["sign"].isNull() & (at["left"] < b["n"])
        return F.struct((at["left"] - b["n"]).alias("left"), F.when(found, b["sign"]).otherwise(at["sign"]).alias("sign"), F.when(found, b["place"]).otherwise(at["place"]).alias("place"))

    value = lambda at: at["sign"] * (F.lit(2.0) * F.pow(F.lit(gamma), at["sign"] * at["place"]) / F.lit(gamma + 1))
    return F.least(F.greatest(F.aggregate("bins", start, step, value), F.col("low")), F.col("high"))


def quantiles(states: DataFrame, keys: list[str], of: list[float], accuracy: float = 0.01) -> DataFrame:
    """keys, q, estimate."""
    each = F.array(*[F.struct(F.lit(q).alias("q"), quantile(q, accuracy).alias("estimate")) for q in of])
    return states.select(*keys, F.inline(each))
