"""The two-stream join of latest values, replayed over a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .names import fresh


def latest_join(df: DataFrame, key: str, order: str, side: Column, value: Column) -> DataFrame:
    """A pair at each row whose key has both sides by then: the newest value of each. side is true for left rows, false for
    right ones."""
    by = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    latest = lambda mine: F.last(F.when(mine, value), ignorenulls=True).over(by)
    both = df.withColumns({"left_value": latest(side), "right_value": latest(~side)})
    return both.where("left_value IS NOT NULL AND right_value IS NOT NULL")


def latest_join_timeouts(df: DataFrame, key: str, order: str, side: Column, value: Column, delay: str, ts: str = "ts") -> DataFrame:
    """For each key whose other side did not come within delay of its first row: the row's time, when it timed out, and
    the newest value of its side by then. The clock is the event time."""
    by = Window.partitionBy(key)
    left, opened, other_ts = fresh(df.columns, "left", "first", "other")
    rows = df.withColumn(left, side)
    first = F.min_by(F.struct(F.col(left).alias("left"), ts), F.col(order)).over(by)
    rows = rows.withColumns({opened: first, "first_ts": F.min(ts).over(by)})
    deadline = F.col("first_ts") + F.expr(f"INTERVAL '{delay}'")
    same = F.col(left) == F.col(opened)["left"]
    other = F.min(F.when(~same, F.col(ts)))
    newest = F.max_by(value, F.when(same & (F.col(ts) <= deadline), F.col(order)))
    out = rows.groupBy(key, F.col(opened)["left"].alias("is_left"), "first_ts", deadline.alias("timeout_ts")).agg(other.alias(other_ts), newest.alias("last_value"))
    return out.where(F.col(other_ts).isNull() | (F.col(other_ts) > F.col("timeout_ts"))).drop(other_ts)
