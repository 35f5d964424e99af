"""Interval send of a stream: the newest row of a key for each interval, sent at the interval's end.

Each micro-batch goes through the batch form (operators/throttle.py) together with the intervals that the batch before left open,
one row a key: that row has the time at which its interval was opened, and the newest value so far. So Python is called for
Arrow batches of many keys, not for each key and timer, and a key of many rows is cut into blocks.

An interval's row is sent when a row of its key closes the interval, or when the watermark, the largest event time of the stream
less a delay, reaches its end. Keys keep their last interval: where rows come later than that delay, what they change in an
interval that was sent is sent again, and the last send of an interval counts. So results follow the order of the rows and not
the watermark, and no row is dropped as late. Sends and open intervals are committed tables (sinks/committed.py) by the
number of the batch: a batch that runs again finds the intervals that it found before and its sends are there once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import throttle
from ..sinks import committed
from .lateness import partitions_by_size


@dataclass
class IntervalSends:
    """top: a folder of its own. order: a whole-number column that rows come in the order of. ts: their event time, an instant."""

    top: str
    key: str
    order: str
    value: str
    interval_us: int
    delay_us: int = 0
    ts: str = "ts"

    def __call__(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch."""
        with partitions_by_size(batch.sparkSession):
            self._batch(batch, number)

    def _batch(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        carried = committed.top_before(f"{self.top}/marks", "us", number)
        seen = batch.agg(F.max(F.unix_micros(self.ts))).first()[0]
        mark = max((x for x in (seen, carried) if x is not None), default=None)
        o = F.col(self.order).cast("long").alias("o")
        held = F.struct(F.col(self.value).alias("v"), o, F.lit(False).alias("sent"))
        rows = batch.select(F.col(self.key).alias("k"), o, F.col(self.ts).alias("ts"), held.alias("held"))
        if number:
            rows = rows.unionByName(self._open(spark, number - 1).select("k", "held.o", F.timestamp_micros(F.col("sent_us") - self.interval_us).alias("ts"), "held"))
        sends = throttle.interval_send(rows, "k", "o", "held", self.interval_us, eager=False)
        last = F.max("sent_us").over(Window.partitionBy("k"))
        passed = F.col("sent_us") <= F.lit(throttle.NONE if mark is None else mark - self.delay_us)
        sends = sends.withColumn("open", F.col("sent_us") == last).withColumn("due", ~F.col("open") | passed).persist()
        try:
            committed.append(sends.where("due AND NOT held.sent").select("k", "sent_us", "held.v", "held.o"), f"{self.top}/sent", number)
            left = sends.where("open").withColumn("held", F.col("held").withField("sent", F.col("held.sent") | F.col("due")))
            committed.append(left.select("k", "sent_us", "held"), f"{self.top}/open", number)
        finally:
            sends.unpersist()
        one = spark.range(0, 1, 1, 1).select(F.lit(mark).cast("long").alias("us"))
        committed.append(one, f"{self.top}/marks", number, ["us"])
        committed.forget(f"{self.top}/open", number - 1)

    def _open(self, spark: SparkSession, number: int) -> DataFrame:
        """Of each key its last interval, as a batch left it."""
        return committed.read(spark, f"{self.top}/open", first=number, last=number)

    def results(self, spark: SparkSession, ended: bool = False) -> DataFrame:
        """key, sent_us and value of what was sent; ended: the stream is over, so that intervals still open are sent too."""
        done = committed.read(spark, f"{self.top}/sent")
        if ended:
            still = self._open(spark, max(committed.numbers(f"{self.top}/open"))).where("NOT held.sent")
            done = done.unionByName(still.select("k", "sent_us", "held.v", "held.o"))
        got = done.groupBy("k", "sent_us").agg(F.max_by(F.struct("v"), "o")["v"].alias("v"))
        return got.select(F.col("k").alias(self.key), "sent_us", F.col("v").alias(self.value))
