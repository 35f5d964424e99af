"""Late rows under a watermark that follows each row: a batch replay of the streaming semantics.

Rows come in the order of a whole-number column. The watermark at a row is the largest event time of the rows before it.
A window ends for good once the watermark reaches its end plus the allowed lateness.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import running


def with_watermark(df: DataFrame, order: str, ts: str = "ts") -> DataFrame:
    return running(df, order, F.col(ts), "wm")


def with_window(df: DataFrame, size: str, ts: str = "ts") -> DataFrame:
    w = F.window(ts, size)
    return df.withColumn("__w", w).withColumns({"win_start": F.col("__w.start"), "win_end": F.col("__w.end")}).drop("__w")


def late_rows(df: DataFrame, order: str, size: str, lateness: str = "0 seconds", ts: str = "ts") -> DataFrame:
    """Rows whose window had ended when they came."""
    rows = with_window(with_watermark(df, order, ts), size, ts)
    return rows.where(F.col("wm") >= F.col("win_end") + F.expr(f"INTERVAL '{lateness}'"))


def firings(df: DataFrame, order: str, size: str, keys: list[str], lateness: str, ts: str = "ts") -> DataFrame:
    """Results of a counting window with allowed lateness: one when the window ends, and one, with the count so far, for
    each later row that comes before the lateness is over. Columns: keys, win_start, kind (main or refire), cnt."""
    rows = with_window(with_watermark(df, order, ts), size, ts)
    rows = rows.where(F.col("wm").isNull() | (F.col("wm") < F.col("win_end") + F.expr(f"INTERVAL '{lateness}'")))
    late = F.coalesce(F.col("wm") >= F.col("win_end"), F.lit(False))
    so_far = F.count("*").over(Window.partitionBy(*keys, "win_start").orderBy(order))
    refires = rows.withColumn("cnt", so_far).where(late).select(*keys, "win_start", F.lit("refire").alias("kind"), "cnt")
    main = rows.where(~late).groupBy(*keys, "win_start").agg(F.count("*").alias("cnt")).select(*keys, "win_start", F.lit("main").alias("kind"), "cnt")
    return main.unionByName(refires)
