"""Upserts as pure DataFrame merges: the state of a table after batches of keyed changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_by_key(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key; combined before the shuffle, so a hot key sends a row for each task."""
    rest = [c for c in changes.columns if c not in keys]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__row"))
    return newest.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def merge(target: DataFrame, changes: DataFrame, keys: list[str], keep_old: list[str] | None = None, delete: Column | None = None) -> DataFrame:
    """target with one change for each key at most merged in. Changed columns take the new value; those in keep_old keep
    theirs unless it is null. Rows whose change meets delete go, after the others are saved."""
    keep_old = keep_old or []
    rest = [c for c in target.columns if c not in keys]
    new = changes.select(*keys, F.struct(*rest).alias("__new"), (F.lit(False) if delete is None else delete).alias("__gone"))
    joined = target.select(*keys, F.struct(*rest).alias("__old")).join(new, keys, "full_outer")
    was, got = F.col("__old").isNotNull(), F.col("__new").isNotNull()

    def value(c: str) -> Column:
        old, changed = F.col(f"__old.{c}"), F.col(f"__new.{c}")
        return (F.coalesce(old, changed) if c in keep_old else F.when(got, changed).otherwise(old)).alias(c)

    return joined.where((was | got) & ~F.coalesce("__gone", F.lit(False))).select(*keys, *[value(c) for c in rest])
