"""Reading the named tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stored: ts has no time zone."""
    return load(spark, sf_dir, "events")


def events_stream(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """The event table as a stream of files, with ts as an instant, which watermarks need."""
    schema = events(spark, sf_dir).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))
