"""Rows described in JSON, made by built-in functions over a range of ids.

[{"type": "long_inc", "fields": {"name": "id", "start": 1, "step": 2}}, ...]. Types: int_random and long_random (start and
end are included, null_ratio), double_random (end is not), long_inc, long_inc_batch (batch), str_fix (len), str_from_list
(values, random), str_list_from_list (values, min, max), ip, timestamp, unix_timestamp, timestamp_formatted.
"""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the alphabet of str_fix.
LETTERS = string.digits + string.ascii_uppercase + string.ascii_lowercase + "-_#*"


def _column(kind: str, o: dict, seed: int) -> Column:
    start, end = o.get("start", 0), o.get("end", 100)
    values = F.array(*[F.lit(v) for v in o.get("values", [""])])
    n = len(o.get("values", [""]))
    if kind in ("int_random", "long_random"):
        out = (F.floor(F.rand(seed) * (end - start + 1)) + start).cast("int" if kind == "int_random" else "long")
    elif kind == "double_random":
        out = F.rand(seed) * (end - start) + start
    elif kind == "long_inc":
        out = F.col("id") * o.get("step", 1) + start
    elif kind == "long_inc_batch":
        out = F.floor(F.col("id") / o["batch"]) + start
    elif kind == "str_fix":
        one = lambda i: F.substring(F.lit(LETTERS), F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(len(LETTERS))).cast("int") + 1, F.lit(1))
        out = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(int(o["len"]))), one), "")
    elif kind == "str_from_list":
        at = F.floor(F.rand(seed) * n) if o.get("random") else F.col("id") % n
        out = F.element_at(values, at.cast("int") + 1)
    elif kind == "str_list_from_list":
        k = F.floor(F.rand(seed) * (o["max"] - o["min"] + 1)).cast("int") + o["min"]
        out = F.slice(F.shuffle(values), F.lit(1), k)
    elif kind == "ip":
        x = F.floor(F.rand(seed) * F.lit(2.0**32)).cast("long")
        out = F.concat_ws(".", *[F.shiftright(x, 8 * i).bitwiseAND(F.lit(255).cast("long")).cast("string") for i in (3, 2, 1, 0)])
    elif kind == "timestamp":
        out = F.unix_millis(F.current_timestamp())
    elif kind == "unix_timestamp":
        out = F.unix_timestamp(F.current_timestamp())
    elif kind == "timestamp_formatted":
        out = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    else:
        raise ValueError(f"no such generator: {kind}")
    return F.when(F.rand(seed + 7919) >= o["null_ratio"], out) if o.get("null_ratio") else out


def generate(spark: SparkSession, spec: str, rows: int, seed: int = 0, as_json: bool = False) -> DataFrame:
    """The described columns, or one column of JSON texts without the null ones."""
    fields = json.loads(spec)
    columns = [_column(f["type"], f["fields"], seed + i).alias(f["fields"]["name"]) for i, f in enumerate(fields)]
    out = spark.range(rows).select(*columns)
    return out.select(F.to_json(F.struct("*")).alias("value")) if as_json else out


def generate_stream(spark: SparkSession, spec: str, speed: int, speed_unit_ms: int = 1000, seed: int = 0, as_json: bool = False) -> DataFrame:
    """The described columns as a stream of speed rows in each speed_unit_ms."""
    fields = json.loads(spec)
    columns = [_column(f["type"], f["fields"], seed + i).alias(f["fields"]["name"]) for i, f in enumerate(fields)]
    per_second = max(1, round(speed * 1000 / speed_unit_ms))
    out = spark.readStream.format("rate").option("rowsPerSecond", per_second).load().withColumnRenamed("value", "id").select(*columns)
    return out.select(F.to_json(F.struct("*")).alias("value")) if as_json else out
