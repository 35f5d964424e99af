"""Ranks and neighbours within groups that may be larger than a task.

A window function brings a group to one task. Here rows are dealt by ranges of group and order, so that a large group lies in
several tasks and rows that are equal in both lie in one; each range ranks its own rows, and a small table, a row for each group
and range, says how many rows came before and which was the last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_dir
from .names import fresh


def ranked(df: DataFrame, keys: list[str], order: list[str], row_number: str | None = None, rank: str | None = None, dense: str | None = None, ntile: tuple[str, int] | None = None, before: tuple[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """df with the columns named: row_number, rank and dense rank in the ascending order of columns (nulls first), which of n
    parts as even as can be (ntile: name and n), and the value of a column in the row before (before: name and column). Rows equal
    in order are numbered in any order. parts: number of ranges; the session's shuffle partitions if not given."""
    spark = df.sparkSession
    part, rn, rk, dr, n, d, last, first = fresh(df.columns, "part", "rn", "rk", "dr", "n", "d", "last", "first")
    dealt = df.repartitionByRange(*([parts] if parts else []), *keys, *order).withColumn(part, F.spark_partition_id())
    path = shared_dir(spark, "ranks")
    dealt.write.parquet(path)  # ranges are drawn from samples, and read two times
    rows = spark.read.schema(dealt.schema).parquet(path)
    inside = Window.partitionBy(*keys, part).orderBy(*order)
    rows = rows.withColumns({rn: F.row_number().over(inside), rk: F.rank().over(inside), dr: F.dense_rank().over(inside)})
    seen = before[1] if before else rn
    rows = rows.withColumn(first, F.lag(F.struct(F.col(seen).alias("v"))).over(inside))
    ranges = rows.groupBy(*keys, part).agg(F.count("*").alias(n), F.max(dr).alias(d), F.max_by(F.struct(F.col(seen).alias("v")), rn).alias(last))
    upto = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum(n).over(Window.partitionBy(*keys))
    ranges = ranges.select(*keys, part, whole.alias("_whole"), *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"_{c}") for c in (n, d)], F.lag(last).over(Window.partitionBy(*keys).orderBy(part)).alias("_last"))
    names = [*keys, part]
    ranges = ranges.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(names)], "_whole", f"_{n}", f"_{d}", "_last")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b._k{i}")) for i, c in enumerate(names)]
    both = rows.alias("a").join(ranges.alias("b"), on)
    place = F.col(f"b._{n}") + F.col(f"a.{rn}")
    out = {}
    if row_number:
        out[row_number] = place
    if rank:
        out[rank] = F.col(f"b._{n}") + F.col(f"a.{rk}")
    if dense:
        out[dense] = F.col(f"b._{d}") + F.col(f"a.{dr}")
    if ntile:
        name, of = ntile
        small, large = F.expr(f"b._whole div {of}"), F.expr(f"b._whole % {of}")
        ahead = large * (small + 1)
        zero = place - 1
        out[name] = F.when(zero < ahead, F.floor(zero / (small + 1)) + 1).otherwise(large + F.floor((zero - ahead) / F.greatest(small, F.lit(1))) + 1)
    if before:
        out[before[0]] = F.coalesce(F.col(f"a.{first}"), F.col("b._last"))["v"]
    return both.select(*[F.col(f"a.{c}").alias(c) for c in df.columns], *[(v if before and c == before[0] else v.cast("bigint")).alias(c) for c, v in out.items()])
