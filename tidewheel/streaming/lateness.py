"""Tumbling windows of a stream with allowed lateness and a second output for late rows.

The watermark follows each row: at a row it is the largest event time of the rows that came before it, in the order of a
whole-number column. A window gives its main result when the watermark reaches its end. It stays for the allowed lateness, and
each row that comes for it in that time gives its result so far again (a refire). Then its state is cleared, and what still
comes for it goes to the late output.

Each micro-batch is joined with the state that the batch before left, by keys and window, so the work is dealt by both; the
watermark that a batch begins with is the largest event time that the tasks of earlier batches have seen, which the log of
the table of marks keeps. Rows on time are counted before the shuffle; only those of the lateness are ranked. State and
results are committed tables (sinks/committed.py) by the number of the batch: a batch that runs again finds the state that it
found before and its results are there once.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..operators.windows import running
from ..sinks import committed

WM, START, END, N = "wm", "win_start", "win_end", "cnt"


@contextmanager
def partitions_by_size(spark: SparkSession) -> Iterator[None]:
    """What is persisted keeps all of the session's shuffle partitions, if this setting does not let them be put together by
    their size: then each table that is written from it has as many tasks, however few the rows."""
    fit = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"
    before = spark.conf.get(fit)
    spark.conf.set(fit, "true")
    try:
        yield
    finally:
        spark.conf.set(fit, before)


@dataclass
class LateWindows:
    """top: a folder of its own. size, lateness: intervals. keys: columns of the windows' key. order: a whole-number column
    that rows come in the order of. ts: their event time, an instant. sums: further results by name, of whole numbers."""

    top: str
    size: str
    lateness: str
    keys: list[str]
    order: str
    ts: str = "ts"
    sums: dict[str, Column] = field(default_factory=dict)

    def __call__(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch."""
        with partitions_by_size(batch.sparkSession):
            self._batch(batch, number)

    def _batch(self, batch: DataFrame, number: int) -> None:
        carried = committed.top_before(f"{self.top}/marks", "us", number)
        rows = running(batch, self.order, F.unix_micros(self.ts), WM).withColumn(WM, F.greatest(WM, F.lit(carried).cast("long")))
        window = F.window(self.ts, self.size)
        rows = rows.withColumns({START: F.unix_micros(window["start"]), END: F.unix_micros(window["end"])}).persist()
        try:
            self._step(rows, number, carried)
        finally:
            rows.unpersist()

    def _step(self, rows: DataFrame, number: int, carried: int | None) -> None:
        spark = rows.sparkSession
        mine = [*self.keys, START]
        held = self._state(spark, rows.schema, number)
        over = F.col(END) + F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL '{self.lateness}'"))
        before = F.coalesce(F.col(WM), F.lit(-(1 << 62)))
        gone = before >= over
        committed.append(rows.where(gone).drop(WM, END), f"{self.top}/late", number)
        alive = rows.where(~gone).withColumn("late", before >= F.col(END))
        sums = {N: F.lit(1).cast("long"), **self.sums}
        on_time = alive.where("NOT late").groupBy(*mine, END).agg(*[F.sum(v).alias(f"new_{c}") for c, v in sums.items()])
        upto = Window.partitionBy(*mine).orderBy(self.order).rowsBetween(Window.unboundedPreceding, 0)
        refires = alive.where("late").select(*mine, END, self.order, *[F.sum(v).over(upto).alias(f"more_{c}") for c, v in sums.items()])
        refires.persist()
        late = refires.groupBy(*mine, END).agg(*[F.max_by(f"more_{c}", self.order).alias(f"more_{c}") for c in sums])
        # what a window had before, what came on time, and what came in its lateness
        windows = held.join(on_time, [*mine, END], "full").join(late, [*mine, END], "full")
        had = {c: F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"new_{c}"), F.lit(0)) for c in sums}
        windows = windows.select(*mine, END, F.coalesce("fired", F.lit(False)).alias("fired"), *[v.alias(c) for c, v in had.items()], *[F.coalesce(f"more_{c}", F.lit(0)).alias(f"more_{c}") for c in sums])
        mark = rows.agg(F.max(F.unix_micros(self.ts)).alias("us")).first().us
        mark = max((x for x in (mark, carried) if x is not None), default=None)
        passed = F.col(END) <= F.lit(mark).cast("long")
        due = ~F.col("fired") & passed & (F.col(N) > 0)
        names = list(sums)
        windows = windows.persist()
        main = windows.where(due).select(*mine, F.lit("main").alias("kind"), *names)
        again = refires.join(windows.select(*mine, *names), mine).select(*mine, F.lit("refire").alias("kind"), *[(F.col(c) + F.col(f"more_{c}")).alias(c) for c in names])
        committed.append(main.unionByName(again), f"{self.top}/fired", number)
        left = windows.where(over > F.lit(mark).cast("long")).select(*mine, END, (F.col("fired") | passed).alias("fired"), *[(F.col(c) + F.col(f"more_{c}")).alias(c) for c in names])
        committed.append(left, f"{self.top}/state", number)
        one = spark.range(0, 1, 1, 1).select(F.lit(mark).cast("long").alias("us"))
        committed.append(one, f"{self.top}/marks", number, ["us"])
        committed.forget(f"{self.top}/state", number - 1)
        windows.unpersist()
        refires.unpersist()

    def _state(self, spark: SparkSession, rows: StructType, number: int) -> DataFrame:
        """What the batch before left."""
        if number:
            return committed.read(spark, f"{self.top}/state", first=number - 1, last=number - 1)
        kinds = [rows[k] for k in self.keys]
        numbers = [StructField(c, LongType()) for c in (START, END, N, *self.sums)]
        return spark.createDataFrame([], StructType([*kinds, *numbers, StructField("fired", BooleanType())]))

    def results(self, spark: SparkSession, ended: bool = False) -> DataFrame:
        """keys, win_start, kind (main or refire), cnt and sums of what has fired; ended: the stream is over, so that windows
        still open have their main result too."""
        done = committed.read(spark, f"{self.top}/fired")
        if ended:
            last = max(committed.numbers(f"{self.top}/state"))
            still = committed.read(spark, f"{self.top}/state", first=last, last=last).where(f"NOT fired AND {N} > 0")
            done = done.unionByName(still.select(*self.keys, START, F.lit("main").alias("kind"), N, *self.sums))
        return done.withColumn(START, F.timestamp_micros(START))

    def late(self, spark: SparkSession) -> DataFrame:
        """The late rows, with the start of their window."""
        return committed.read(spark, f"{self.top}/late").withColumn(START, F.timestamp_micros(START))
