"""Generated rows and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import latest_by_key
from ..session import shared_dir
from ..sinks.batched import log_lines
from ..sources import faker, fieldgen, files, lengths
from ..tables import events, load
from .registry import query

# Names of options and expressions are the connector's interface.
FIELDS = {
    "fields.id.expression": "#{number.numberBetween '1','1000'}",
    "fields.name.expression": "#{superhero.name}",
    "fields.mail.expression": "#{internet.emailAddress}",
    "fields.mail.null-rate": "0.25",
    "fields.code.expression": "#{regexify '[A-C]{2}-\\d{3}'}",
    "seed": "7",
}


@query("faker_scan")
def faker_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faker.scan(spark, "id int, name string, mail string, code string", FIELDS | {"number-of-rows": "500"})


@query("faker_checked", "SELECT 500 AS n, true AS ids, true AS mails, true AS codes, true AS same")
def faker_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for any seed: numbers in their range, forms of texts, about a quarter of nulls, and equal rows again."""
    rows = faker_scan(spark, sf_dir)
    again = faker_scan(spark, sf_dir).select(F.xxhash64("id", "name", "mail", "code").alias("h")).agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("h"))
    got = rows.agg(
        F.count("*").alias("n"), F.bool_and(F.col("id").between(1, 999)).alias("ids"), ((F.count("mail") > 325) & (F.count("mail") < 425) & F.bool_and(F.col("mail").rlike("^[a-z]{8}[0-9]{1,2}@example[.]com$"))).alias("mails"),
        F.bool_and(F.col("code").rlike("^[A-C]{2}-[0-9]{3}$")).alias("codes"), F.sum(F.xxhash64("id", "name", "mail", "code").cast("decimal(38,0)")).alias("h"),
    )
    return got.join(again, "h").select(F.col("n").cast("int").alias("n"), "ids", "mails", "codes", F.lit(True).alias("same"))


@query("faker_types", "SELECT 1.50::DECIMAL(10,2) AS d, DATE '2024-02-29' AS day, 7::TINYINT AS small, 3::BIGINT AS n_rows, 'x' AS word, 4::INTEGER AS number, 2::BIGINT AS n_numbers FROM range(100)")
def faker_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = {f"fields.{k}.expression": f"#{{options.option '{v}'}}" for k, v in {"d": "1.499999", "day": "2024-02-29", "small": "7", "rows.w": "x", "rows.n": "4", "numbers": "5"}.items()}
    options |= {"fields.rows.length": "3", "fields.numbers.length": "2", "number-of-rows": "100"}
    got = faker.scan(spark, "d decimal(10,2), day date, small tinyint, rows array<struct<w: string, n: int>>, numbers array<bigint>", options)
    row = F.element_at("rows", 2)
    return got.select("d", "day", "small", F.size("rows").cast("long").alias("n_rows"), row["w"].alias("word"), row["n"].alias("number"), F.size("numbers").cast("long").alias("n_numbers"))


@query("fieldgen_checked", "SELECT 1000 AS n, true AS numbers, true AS texts, true AS lists, true AS addresses")
def fieldgen_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for any seed of fieldgen_random."""
    rows = fieldgen_random(spark, sf_dir)
    return rows.agg(
        F.count("*").cast("int").alias("n"), (F.bool_and(F.col("n").between(1, 5)) & (F.count("n") > 850) & (F.count("n") < 950)).alias("numbers"), F.bool_and(F.length("s") == 8).alias("texts"),
        F.bool_and(F.size("l").between(1, 3) & F.forall("l", lambda x: x.isin("x", "y", "z"))).alias("lists"), F.bool_and(F.col("ip").rlike(r"^\d{1,3}(\.\d{1,3}){3}$")).alias("addresses"),
    )


@query("faker_lookup")
def faker_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faker.lookup(load(spark, sf_dir, "nation"), ["n_nationkey"], "n_nationkey int, name string", FIELDS)


@query("fieldgen_scan", "SELECT 10 + 2 * range AS id, range // 4 AS batch, ['a', 'b', 'c'][range % 3 + 1] AS letter FROM range(1000)")
def fieldgen_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = """[{"type": "long_inc", "fields": {"name": "id", "start": 10, "step": 2}}, {"type": "long_inc_batch", "fields": {"name": "batch", "batch": 4}},
               {"type": "str_from_list", "fields": {"name": "letter", "values": ["a", "b", "c"]}}]"""
    return fieldgen.generate(spark, spec, 1000)


@query("fieldgen_random")
def fieldgen_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = """[{"type": "int_random", "fields": {"name": "n", "start": 1, "end": 5, "null_ratio": 0.1}}, {"type": "str_fix", "fields": {"name": "s", "len": 8}},
               {"type": "str_list_from_list", "fields": {"name": "l", "values": ["x", "y", "z"], "min": 1, "max": 3}}, {"type": "ip", "fields": {"name": "ip"}}]"""
    return fieldgen.generate(spark, spec, 1000, seed=3)


@query("text_repeat", "SELECT c AS cycle, event_type AS value, count(*) AS n FROM events, (SELECT unnest([1, 2, 3])::INTEGER AS c) GROUP BY 1, 2")
def text_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "text")
    events(spark, sf_dir).select(F.explode(F.array(F.concat(F.lit(" "), "event_type"), F.lit(" "))).alias("value")).write.text(path)
    return files.repeated_text(spark, path, 3).groupBy("cycle", "value").agg(F.count("*").alias("n"))


@query("len_delimited", "SELECT event_type AS payload, count(*) AS n FROM events GROUP BY 1")
def len_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their lengths, written as bytes and read back by ranges of 16 KB. The text sink puts a line end behind each file; here it
    is the last byte of an empty record, which is left out again."""
    path = shared_dir(spark, "records")
    record = F.concat(F.unhex(F.lpad(F.hex(F.octet_length("event_type")), 8, "0")), F.encode("event_type", "UTF-8"))
    rows = events(spark, sf_dir).select(F.floor(F.col("event_id") / 20_000).alias("part"), F.hex(record).alias("h"))
    whole = rows.groupBy("part").agg(F.array_join(F.collect_list("h"), "").alias("h"))
    ends = whole.select(F.unhex(F.concat("h", F.lit("00000000"))).alias("b"))
    ends.select(F.substring("b", 1, F.octet_length("b") - 1).cast("string").alias("value")).write.option("lineSep", "\0").text(path)
    read = lengths.length_delimited(spark, path, 1 << 14).where(F.octet_length("payload") > 0)
    return read.groupBy(F.decode("payload", "UTF-8").alias("payload")).agg(F.count("*").alias("n"))


@query("sequences", "SELECT range * 3 + 5 AS id FROM range(1000)")
def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(5, 3005, 3)


@query("log_sink", "SELECT '+I: {\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS line FROM events")
def log_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lines(events(spark, sf_dir).select("event_id", "event_type"))


@query("batch_latest", "SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def batch_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a keyed batch sink writes: one row for each key."""
    return latest_by_key(events(spark, sf_dir).select("user_id", "event_id", "value"), ["user_id"], "event_id").select("user_id", "value")
