"""Running a stream over what is there now, and reading what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.names import fresh
from ..session import shared_dir
from ..sinks.committed import Committed


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream puts out over the data that is there: in append mode all rows, in complete mode the last result, in
    update mode every update with the number of its batch."""
    spark = stream.sparkSession
    top = shared_dir(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/out/{'last' if mode == 'complete' else f'batch={number}'}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{top}/out/last")
    out = spark.read.parquet(f"{top}/out")
    return out if mode == "update" else out.drop("batch")


#: Beyond all event times: the watermark after the last row of a stream that has ended.
END = "2999-12-31 00:00:00"


def arriving(df: DataFrame, order: str, parts: int = 6, most: int = 2_000_000, end: str | None = None, each: int = 250_000) -> DataFrame:
    """A stream of df's rows in micro-batches that follow a whole-number column: parts of them, or more, so that about most
    rows come at once. The rows are written to the shared folder, a folder for each micro-batch, one after the other. All have
    the same number of files, about each rows in one, so that tasks share in writing and reading a micro-batch.
    end: an instant's column; a last row follows that has END there and nulls else, which moves the watermark past all timers.
    Leave it out by a condition on that column, since others are moved in front of the watermark."""
    spark = df.sparkSession
    low, high, n = df.agg(F.min(order), F.max(order), F.count("*")).first()
    parts, path, dealt = max(parts, -(-n // most)), shared_dir(spark, "arriving"), shared_dir(spark, "dealt")
    files = max(1, -(-n // (parts * each)))
    step = ((high or 0) - (low or 0)) // parts + 1
    # one pass deals the rows to their micro-batches, whatever their number; each is then read by itself
    (part,) = fresh(df.columns, "part")
    df.withColumn(part, F.floor((F.col(order) - (low or 0)) / step).cast("int")).write.partitionBy(part).parquet(dealt)
    kept = spark.read.schema(df.withColumn(part, F.lit(0)).schema).parquet(dealt)
    for k in range(parts):
        to = f"{path}/{k:09d}"
        kept.where(F.col(part) == k).drop(part).repartition(files, order).write.option("maxRecordsPerFile", 0).parquet(to)
        # the stream counts files: tasks without rows wrote none
        there = len(spark.read.schema(df.schema).parquet(to).inputFiles()) if files > 1 else 1
        for _ in range(files - there):
            spark.createDataFrame([], df.schema).repartition(1).write.mode("append").parquet(to)
    if end:
        last = [F.lit(END if c == end else None).cast(t).alias(c) for c, t in df.dtypes]
        spark.range(1).select(*last).repartition(1).write.parquet(f"{path}/{parts:09d}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/*")


def run_batches(stream: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls put with each micro-batch of what is there, and its number; a stopped run goes on from the checkpoint."""
    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_into(stream: DataFrame, path: str, checkpoint: str, sink: type[Committed] = Committed, **options: str) -> None:
    """Puts what is there into a committed table (sinks/committed.py); a stopped run goes on from the checkpoint."""
    stream.sparkSession.dataSource.register(sink)
    out = stream.writeStream.format(sink.name()).option("path", path).options(**options)
    out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
