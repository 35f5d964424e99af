"""Files as rows: repeated text and trimmed text; see lengths.py for length-delimited records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_lines(spark: SparkSession, path: str, trim: bool = True, least_bytes: int = 0) -> DataFrame:
    """Lines of text files, without blank ones (trim) or those of fewer bytes; the last line counts without a newline."""
    lines = spark.read.text(path)
    if trim:
        return lines.select(F.trim("value").alias("value")).where("value <> ''")
    return lines.where(F.octet_length("value") >= least_bytes)


def repeated_text(spark: SparkSession, path: str, cycles: int, rows: int | None = None) -> DataFrame:
    """The lines of text_lines, cycles times over: cycle, value. rows limits them, where a sample is asked for."""
    out = text_lines(spark, path).select(F.explode(F.sequence(F.lit(1), F.lit(cycles))).alias("cycle"), "value")
    return out if rows is None else out.limit(rows)


def directory_stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files of a directory and those below it, each file once, as they come."""
    return spark.readStream.option("recursiveFileLookup", "true").text(path)


def socket_stream(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def kafka_stream(spark: SparkSession, servers: str, topics: str, start: str = "latest") -> DataFrame:
    """Records of Kafka topics; needs the connector on the class path. start: earliest, latest or offsets as JSON."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("startingOffsets", start).load()


class Reloading:
    """A table that is read again once it is older than interval seconds; for use inside foreachBatch."""

    def __init__(self, read, interval: float = 600, retries: int = 3, fail: bool = True, clock=None):  # noqa: ANN001
        import time

        self.read, self.interval, self.retries, self.fail, self.clock = read, interval, retries, fail, clock or time.monotonic
        self.at, self.held = None, None

    def get(self) -> DataFrame:
        now = self.clock()
        if self.at is None or now - self.at >= self.interval:
            for n in range(self.retries):
                try:
                    self.held, self.at = self.read(), now
                    break
                except Exception:
                    if n == self.retries - 1 and (self.fail or self.held is None):
                        raise
        return self.held
