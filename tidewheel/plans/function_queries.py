"""Granularities, strings, coercion and codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, coercion, protobuf, strings, times
from ..functions.granularity import Granularity, epoch_day, interval_floor, path_of, time_of_path
from ..tables import events, load
from .registry import query

_EVERY = {
    "second": ("SECOND", "date_trunc('second', ts)"),
    "minute": ("MINUTE", "date_trunc('minute', ts)"),
    "minute5": ("FIVE_MINUTE", "time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01')"),
    "minute10": ("TEN_MINUTE", "time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01')"),
    "minute15": ("FIFTEEN_MINUTE", "time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01')"),
    "minute30": ("THIRTY_MINUTE", "time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01')"),
    "hour": ("HOUR", "date_trunc('hour', ts)"),
    "hour6": ("SIX_HOUR", "time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')"),
    "hour8": ("EIGHT_HOUR", "time_bucket(INTERVAL 8 HOUR, ts, TIMESTAMP '1970-01-01')"),
    "day": ("DAY", "date_trunc('day', ts)"),
    "week": ("WEEK", "date_trunc('week', ts)"),
    "month": ("MONTH", "date_trunc('month', ts)"),
    "quarter": ("QUARTER", "date_trunc('quarter', ts)"),
    "year": ("YEAR", "date_trunc('year', ts)"),
}


def _bucketed(granularity: Granularity):  # noqa: ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bucket = granularity.floor(F.col("ts"))
        return events(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("cnt"))

    return run


for _name, (_kind, _sql) in _EVERY.items():
    query(f"gran_{_name}", f"SELECT ({_sql})::TIMESTAMP AS bucket, count(*) AS cnt FROM events GROUP BY 1")(_bucketed(Granularity.of(_kind)))

query("gran_all", "SELECT TIMESTAMP '0001-01-01' AS bucket, count(*) AS cnt FROM events")(_bucketed(Granularity.of("ALL")))
query("gran_none", "SELECT date_trunc('millisecond', ts)::TIMESTAMP AS bucket, count(*) AS cnt FROM events GROUP BY 1")(_bucketed(Granularity.of("NONE")))
_ORIGIN = 1_705_276_800_000_000  # 2024-01-15
query("gran_origin", "SELECT time_bucket(INTERVAL 3 DAY, ts, TIMESTAMP '2024-01-15')::TIMESTAMP AS bucket, count(*) AS cnt FROM events GROUP BY 1")(_bucketed(Granularity.of("P3D", _ORIGIN)))
query("gran_duration", "SELECT make_timestamp(epoch_us(ts) - ((epoch_us(ts) - 1705276800000000) % 5400000000 + 5400000000) % 5400000000) AS bucket, count(*) AS cnt FROM events GROUP BY 1")(
    _bucketed(Granularity.of(f'{{"type": "duration", "duration": 5400000, "origin": {_ORIGIN // 1000}}}'))
)
query("gran_months", "SELECT time_bucket(INTERVAL 2 MONTH, ts, TIMESTAMP '1970-01-01')::TIMESTAMP AS bucket, count(*) AS cnt FROM events GROUP BY 1")(_bucketed(Granularity.of("P2M")))
_FROM_STARTS = "SELECT start::TIMESTAMP AS bucket, count(*) AS cnt FROM events ASOF JOIN (SELECT {start} AS start FROM range(-1200, 1200) r(n)) s ON ts >= start GROUP BY 1"
query("gran_compound", _FROM_STARTS.format(start="TIMESTAMP '1970-01-01' + to_months(n::INTEGER) + to_days((2 * n)::INTEGER)"))(_bucketed(Granularity.of("P1M2D")))
query("gran_month_origin", _FROM_STARTS.format(start="TIMESTAMP '2024-01-15 10:00:00' + to_months(n::INTEGER)"))(_bucketed(Granularity.of("P1M", _ORIGIN + 36_000_000_000)))
query("gran_millis", "SELECT make_timestamp(epoch_us(ts) - epoch_us(ts) % 1500000) AS bucket, count(*) AS cnt FROM events GROUP BY 1")(_bucketed(Granularity.of('{"type": "duration", "duration": 1500}')))
query("gran_timezone", "SELECT timezone('UTC', timezone('America/New_York', date_trunc('day', timezone('America/New_York', timezone('UTC', ts)))))::TIMESTAMP AS bucket, count(*) AS cnt FROM events GROUP BY 1")(
    _bucketed(Granularity.of("P1D", zone="America/New_York"))
)


@query("gran_bounds", "SELECT event_id, (date_trunc('week', ts) + INTERVAL 7 DAY)::TIMESTAMP AS next_week, date_trunc('hour', ts) = ts AS on_hour FROM events")
def gran_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    week, ts = Granularity.of("WEEK"), F.col("ts")
    return events(spark, sf_dir).select("event_id", week.next(week.floor(ts)).alias("next_week"), Granularity.of("HOUR").is_aligned(ts).alias("on_hour"))


@query("path_format", "SELECT event_id, strftime(ts, 'y=%Y/m=%m/d=%d/H=%H') AS path, strftime(ts, 'dt=%Y-%m-%d-%H') AS hive, strftime(ts, '%Y/%m/%d') AS lower FROM events")
def path_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return events(spark, sf_dir).select("event_id", path_of(ts, "HOUR").alias("path"), path_of(ts, "HOUR", "hive").alias("hive"), path_of(ts, "DAY", "lower").alias("lower"))


@query("path_parse", "SELECT event_id, date_trunc('hour', ts)::TIMESTAMP AS from_path, date_trunc('day', ts)::TIMESTAMP AS from_hive FROM events")
def path_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = path_format(spark, sf_dir)
    return paths.select("event_id", time_of_path(F.col("path"), "HOUR").alias("from_path"), time_of_path(F.col("hive"), "DAY").alias("from_hive"))


@query("ts_floor", "WITH e AS (SELECT event_id, epoch(ts)::BIGINT AS s FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)) SELECT event_id, s - s % 60 AS m1, s - s % 300 AS m5, s - s % 600 AS m10, s - s % 3600 AS h1, -s - (-s % 300) AS negative FROM e")
def ts_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    steps = {"m1": 60, "m5": 300, "m10": 600, "h1": 3600}
    return events(spark, sf_dir).select("event_id", *[interval_floor(s, n).alias(k) for k, n in steps.items()], interval_floor(-s, 300).alias("negative"))


@query("days_epoch", "SELECT event_id, (ts::DATE - DATE '1970-01-01')::INTEGER AS utc_day, (timezone('Asia/Shanghai', timezone('UTC', ts))::DATE - DATE '1970-01-01')::INTEGER AS local_day FROM events")
def days_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", epoch_day(F.col("ts")).alias("utc_day"), epoch_day(F.col("ts"), "Asia/Shanghai").alias("local_day"))


@query(
    "string_fns",
    """SELECT c_custkey, lpad(c_name, 24, '*') AS padded_left, rpad(c_name, 4, '*') AS padded_right, '' AS padded_none, repeat(c_mktsegment, 2) AS twice,
         replace(c_name, '#', '/') AS replaced, replace(c_name, 'C', '') AS removed, upper(c_mktsegment) AS upper_case, lower(c_mktsegment) AS lower_case,
         to_base64(encode(c_name)) AS base64_text, replace(c_name, '#', '%23') AS url, left(c_name, 5) AS chopped, trim('/' || c_mktsegment || '//', '/') AS trimmed FROM customer""",
)
def string_fns(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    return load(spark, sf_dir, "customer").select(
        "c_custkey", strings.pad_left(name, 24, "*").alias("padded_left"), strings.pad_right(name, 4, "*").alias("padded_right"), strings.pad_left(name, 0, "*").alias("padded_none"),
        F.repeat(segment, 2).alias("twice"), strings.replace_char(name, "#", "/").alias("replaced"), strings.remove_char(name, "C").alias("removed"), F.upper(segment).alias("upper_case"),
        F.lower(segment).alias("lower_case"), F.base64(F.encode(name, "UTF-8")).alias("base64_text"), strings.url_encoded(name).alias("url"), strings.chop_loosely(name, 5).alias("chopped"),
        strings.trim_slashes(F.concat(F.lit("/"), segment, F.lit("//"))).alias("trimmed"),
    )


@query("string_chop", "SELECT doc_id, (SELECT max(left(text, k::INTEGER)) FROM range(0, 25) r(k) WHERE octet_length(encode(left(text, k::INTEGER))) <= 24) AS chopped FROM documents")
def string_chop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", strings.chop(F.col("text"), 24).alias("chopped"))


@query("epoch_coerce", "SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS from_seconds, date_trunc('millisecond', ts)::TIMESTAMP AS from_millis, date_trunc('second', ts)::TIMESTAMP AS from_text FROM events")
def epoch_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    return events(spark, sf_dir).select(
        "event_id", coercion.epoch_time(F.floor(ms / 1000)).alias("from_seconds"), coercion.epoch_time(ms).alias("from_millis"), coercion.text_time(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("from_text")
    )


_BIG = "(o_orderkey * 70000 + 17)"


@query(
    "num_coerce",
    f"""SELECT o_orderkey, (({_BIG} + 2147483648) % 4294967296 - 2147483648)::INTEGER AS as_int, (({_BIG} + 128) % 256 - 128)::TINYINT AS as_byte,
          o_orderkey::BIGINT AS from_text, 0::INTEGER AS from_junk, trunc(o_totalprice)::BIGINT AS from_double FROM orders""",
)
def num_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = F.col("o_orderkey").cast("long") * 70000 + 17
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", coercion.number(big, "int").alias("as_int"), coercion.number(big, "tinyint").alias("as_byte"), coercion.number(F.col("o_orderkey").cast("string"), "bigint").alias("from_text"),
        coercion.number(F.lit("no number"), "int").alias("from_junk"), coercion.number(F.col("o_totalprice"), "bigint").alias("from_double"),
    )


@query("null_defaults", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS event_type, CASE WHEN event_id % 2 = 0 THEN 0.0::DOUBLE ELSE value END AS value, CASE WHEN event_id % 5 = 0 THEN 0::BIGINT ELSE user_id END AS user_id FROM events")
def null_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    hole = lambda c, n: F.when(F.col("event_id") % n != 0, F.col(c))
    return events(spark, sf_dir).select("event_id", coercion.with_default(hole("event_type", 3), "string").alias("event_type"), coercion.with_default(hole("value", 2), "double").alias("value"), coercion.with_default(hole("user_id", 5), "bigint").alias("user_id"))


@query(
    "json_decode",
    """SELECT event_id, CASE WHEN event_id % 10 <> 3 THEN json_extract_string(props, '$.k')::INTEGER END AS k, CASE WHEN event_id % 10 <> 3 THEN json_extract_string(props, '$.k') END AS text,
         NULL::DOUBLE AS missing FROM (SELECT event_id, props FROM events)""",
)
def json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth text is broken; its row stays, with nulls."""
    text = F.when(F.col("event_id") % 10 == 3, F.lit("{broken")).otherwise(F.replace("props", F.lit('"k"'), F.lit("'k'")))
    again = F.replace(text, F.lit("}"), F.concat(F.lit(", 'text': "), F.regexp_extract("props", r"(\d+)", 1), F.lit("}")))
    row = coercion.json_row(again, "k int, text string, missing double").alias("row")
    return events(spark, sf_dir).select("event_id", row).select("event_id", "row.*")


@query(
    "json_checked",
    """SELECT event_id, event_id % 10 <> 3 AS is_row, event_id % 10 NOT IN (3, 4) AS has_all, CASE WHEN event_id % 10 <> 3 THEN json_extract_string(props, '$.k')::INTEGER END AS k FROM events""",
)
def json_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rows and rows without a field told from good ones."""
    more = F.concat(F.regexp_replace("props", r"\}\s*$", ""), F.lit(', "more": 1}'))
    text = F.when(F.col("event_id") % 10 == 3, F.lit("{broken")).when(F.col("event_id") % 10 == 4, F.col("props")).otherwise(more)
    loose, strict = coercion.json_checked(text, "k int", ignore_errors=True), coercion.json_checked(text, "k int, more int", fail_on_missing=True, ignore_errors=True)
    return events(spark, sf_dir).select("event_id", loose.isNotNull().alias("is_row"), strict.isNotNull().alias("has_all"), loose["k"].alias("k"))


@query("months_apart", "SELECT o_orderkey, (sign(date_diff('day', DATE '1995-05-31', o_orderdate)) * datesub('month', least(DATE '1995-05-31', o_orderdate), greatest(DATE '1995-05-31', o_orderdate)))::INTEGER AS months FROM orders WHERE day(o_orderdate) < 28")
def months_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lit("1995-05-31 00:00:00").cast("timestamp_ntz")
    return load(spark, sf_dir, "orders").where(F.dayofmonth("o_orderdate") < 28).select("o_orderkey", times.months_apart(start, F.col("o_orderdate").cast("timestamp_ntz")).alias("months"))


@query("url_decode", "SELECT c_custkey, c_name || ' &' AS name FROM customer")
def url_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select("c_custkey", strings.url_decoded(strings.url_encoded(F.concat("c_name", F.lit(" &")))).alias("name"))


_RECORD: protobuf.Schema = [("event_id", 1, "int64", "singular"), ("event_type", 2, "string", "singular"), ("value", 3, "double", "optional"), ("marks", 4, "int32", "repeated")]


@query("protobuf_roundtrip", "SELECT event_id, event_type, CASE WHEN event_id % 4 <> 0 THEN value END AS value, CASE WHEN event_id % 3 = 0 THEN '' ELSE (event_id % 7)::VARCHAR || ',' || (event_id % 11)::VARCHAR END AS marks FROM events")
def protobuf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.when(F.col("event_id") % 3 == 0, F.array().cast("array<int>")).otherwise(F.array(F.col("event_id") % 7, F.col("event_id") % 11).cast("array<int>"))
    rows = events(spark, sf_dir).select(F.struct("event_id", "event_type", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("value"), marks.alias("marks")).alias("row"))
    back = rows.select(protobuf.decode(protobuf.encode(F.col("row"), _RECORD), _RECORD, defaults=True).alias("row")).select("row.*")
    return back.withColumn("marks", F.array_join(F.col("marks").cast("array<string>"), ","))


_NESTED: protobuf.Schema = [
    ("event_id", 1, "int64", "singular"), ("kind", 2, {"UNKNOWN": 0, "VIEW": 1, "CLICK": 2, "OTHER": 7}, "singular"), ("delta", 3, "sint64", "singular"), ("code", 4, "fixed32", "singular"),
    ("user", 5, [("id", 1, "uint32", "singular"), ("tags", 2, "string", "repeated")], "singular"), ("parts", 6, [("n", 1, "sint32", "singular"), ("at", 2, "sfixed64", "optional")], "repeated"),
]


@query(
    "protobuf_nested",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'VIEW' WHEN 'click' THEN 'CLICK' ELSE 'OTHER' END AS kind, -event_id * 3 AS delta, (event_id % 1000)::INTEGER AS code,
         (user_id % 1000)::INTEGER AS user_id, event_type AS tag, (-event_id % 50)::INTEGER AS n, event_id * 7 AS at, 2::INTEGER AS n_parts FROM events""",
)
def protobuf_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in messages, repeated ones, enumerations by name, and the signed and fixed integer types."""
    kind = F.when(F.col("event_type") == "view", "VIEW").when(F.col("event_type") == "click", "CLICK").otherwise("OTHER").alias("kind")
    user = F.struct((F.col("user_id") % 1000).alias("id"), F.array("event_type").alias("tags")).alias("user")
    part = lambda at: F.struct((-F.col("event_id") % 50).cast("int").alias("n"), at.cast("long").alias("at"))
    rows = events(spark, sf_dir).select(F.struct("event_id", kind, (-F.col("event_id") * 3).alias("delta"), (F.col("event_id") % 1000).alias("code"), user, F.array(part(F.col("event_id") * 7), part(F.lit(None))).alias("parts")).alias("row"))
    back = rows.select(protobuf.decode(protobuf.encode(F.col("row"), _NESTED), _NESTED, defaults=True).alias("r"))
    first = F.element_at("r.parts", 1)
    return back.select("r.event_id", "r.kind", "r.delta", "r.code", F.col("r.user.id").alias("user_id"), F.element_at("r.user.tags", 1).alias("tag"), first["n"].alias("n"), first["at"].alias("at"), F.size("r.parts").alias("n_parts"))


@query("msgpack_roundtrip", "SELECT event_id AS id, event_type AS name FROM events")
def msgpack_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(codecs.unpack_pair(codecs.pack_pair("event_id", "event_type")).alias("x")).select("x.*")


@query(
    "varint_roundtrip",
    """WITH n AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id * event_id * 1000003 ELSE -event_id * 977 END AS n FROM events)
       SELECT event_id, n, CASE WHEN n = 0 THEN 1 ELSE ceil((floor(log2(CASE WHEN n < 0 THEN -2 * n - 1 ELSE 2 * n END)) + 1) / 7)::INTEGER END AS bytes, n AS fixed_back FROM n""",
)
def varint_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of 64 bits: products that do not fit wrap round (the SQL, which agrees on all that fit, cannot state those)."""
    even = codecs.product(codecs.product("event_id", "event_id"), F.lit(1000003))
    rows = events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 2 == 0, even).otherwise(codecs.product("event_id", F.lit(-977))).alias("n"))
    # what is used more than once has a column of its own, and is not worked out for each byte again
    rows = rows.withColumn("raw", codecs.varint(codecs.zigzag(F.col("n")))).withColumn("eight", codecs.fixed(F.col("n"), 8, big_endian=False))
    back = codecs.unzigzag(codecs.from_varint(F.col("raw")))
    return rows.select("event_id", back.alias("n"), F.octet_length("raw").alias("bytes"), codecs.from_fixed(F.col("eight"), 8, big_endian=False).alias("fixed_back"))


@query("word_count", "SELECT word, count(*) AS cnt FROM (SELECT unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = load(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[ \t\n\r\f\x0B]+")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count("*").alias("cnt"))


@query(
    "timed_words",
    """SELECT ts, word, count(*) AS cnt FROM (SELECT (conv_id * 1000 + turn) AS ts, unnest(regexp_split_to_array(trim(text), '[ \\n]+')) AS word, conv_id FROM conversations)
       WHERE conv_id % 5 <> 0 AND word <> '' GROUP BY 1, 2""",
)
def timed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a time and words; lines whose time is no number are left out."""
    time = F.when(F.col("conv_id") % 5 == 0, F.lit("noon")).otherwise((F.col("conv_id") * 1000 + F.col("turn")).cast("string"))
    parts = load(spark, sf_dir, "conversations").select(F.split(F.concat_ws(" ", time, F.trim("text")), r"[ \n]+").alias("p"))
    words = parts.select(F.element_at("p", 1).try_cast("bigint").alias("ts"), F.explode(F.slice("p", 2, F.size("p"))).alias("word"))
    return words.where("ts IS NOT NULL AND word <> ''").groupBy("ts", "word").agg(F.count("*").alias("cnt"))


@query("computed_columns", "SELECT c_custkey, c_name || ' - ' || c_mktsegment AS label, substr(c_name, 1, 8) AS head, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, CASE WHEN c_acctbal > 0 THEN 'in' ELSE 'out' END AS side FROM customer")
def computed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    exprs = ["c_custkey", "concat(c_name, ' - ', c_mktsegment) AS label", "substr(c_name, 1, 8) AS head", "nvl(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment", "if(c_acctbal > 0, 'in', 'out') AS side"]
    return load(spark, sf_dir, "customer").selectExpr(*exprs)


@query("unix_text", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at FROM events")
def unix_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.from_unixtime(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)).alias("at"))
