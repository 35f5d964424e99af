"""Joins, grouping sets, set operations, ranks and sessions over the star schema: beyond the event operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import balance, partition, ranks
from ..tables import events, load
from .registry import query

PRICE = "(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)))"


def price() -> F.Column:
    return F.col("l_extendedprice").cast("decimal(12,2)") * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))


@query("pricing_summary", f"SELECT l_returnflag, l_linestatus, count(*) AS cnt, sum(l_quantity::DECIMAL(12,2))::DOUBLE AS qty, sum({PRICE})::DOUBLE AS revenue FROM lineitem GROUP BY 1, 2")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("cnt"), F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("double").alias("qty"), F.sum(price()).cast("double").alias("revenue"))


@query("join_revenue", f"SELECT n_name, sum({PRICE})::DOUBLE AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def join_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices are summed by order before the joins, which then carry a row for each order."""
    by_order = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(price()).alias("p"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(load(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = by_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("n_name").agg(F.sum("p").cast("double").alias("revenue"))


@query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select("c_custkey").join(load(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = load(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return load(spark, sf_dir, "customer").select("c_custkey").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("join_outer", "SELECT n_name, r_name, coalesce(cnt, 0) AS cnt FROM nation LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT s_nationkey, count(*) AS cnt FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def join_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = load(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("cnt"))
    nation = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return nation.join(counts, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("n_name", "r_name", F.coalesce("cnt", F.lit(0)).alias("cnt"))


@query("join_broadcast", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a side is sent to all tasks is left to its size at run time."""
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return load(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("join_asof", "SELECT p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view at or before each purchase of the user: one pass over both sides, sorted by user and time."""
    rows = events(spark, sf_dir).where("event_type IN ('view', 'purchase')")
    by = Window.partitionBy("user_id").orderBy("ts", F.desc(F.col("event_type") == "view"), "event_id")
    view = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(by)
    return rows.withColumn("view_id", view).where("event_type = 'purchase' AND view_id IS NOT NULL").select("event_id", "view_id")


@query("rollup_sales", f"SELECT l_returnflag, l_linestatus, count(*) AS cnt, sum({PRICE})::DOUBLE AS revenue FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("cnt"), F.sum(price()).cast("double").alias("revenue"))


@query("cube_sales", "SELECT l_returnflag, l_shipmode, count(*) AS cnt FROM (SELECT l_returnflag, l_linestatus AS l_shipmode FROM lineitem) GROUP BY CUBE (l_returnflag, l_shipmode)")
def cube_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_linestatus").alias("l_shipmode")).cube("l_returnflag", "l_shipmode").agg(F.count("*").alias("cnt"))


@query("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS cnt FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [F.col("o_orderstatus"), F.col("o_orderpriority")]
    return load(spark, sf_dir, "orders").groupingSets([[cols[0]], [cols[1]], []], *cols).agg(F.count("*").alias("cnt"))


@query("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(load(spark, sf_dir, "supplier").select("s_nationkey"))


@query("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(load(spark, sf_dir, "orders").where("o_totalprice > 400000").select("o_custkey"))


@query("distinct_union", "SELECT event_type AS k FROM events UNION SELECT o_orderstatus FROM orders")
def distinct_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("event_type").alias("k")).union(load(spark, sf_dir, "orders").select("o_orderstatus")).distinct()


@query("rank_frames", "SELECT event_id, rank() OVER w AS rnk, dense_rank() OVER w AS dense, lag(event_id) OVER w AS before, ntile(4) OVER w AS quarter FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value, event_id)")
def rank_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of five large groups, each in ranges over several tasks."""
    rows = events(spark, sf_dir).select("event_id", "event_type", "value")
    got = ranks.ranked(rows, ["event_type"], ["value", "event_id"], rank="rnk", dense="dense", ntile=("quarter", 4), before=("before", "event_id"))
    return got.drop("event_type", "value")


@query(
    "session_windows",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
         s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
       SELECT user_id, min(ts) AS first_ts, max(ts) + INTERVAL 6 HOUR AS end_ts, count(*) AS cnt FROM s GROUP BY user_id, n""",
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("cnt"))
    return got.select("user_id", F.col("w.start").alias("first_ts"), F.col("w.end").alias("end_ts"), "cnt")


@query("top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("dealt_rows", "SELECT 'rebalance' AS how, count(*) AS cnt, true AS even, 8 AS tasks FROM events UNION ALL SELECT 'shuffle', count(*), true, 8 FROM events")
def dealt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt in turn and at random: all are there, over as many tasks as asked for, none with over twice its share."""

    def counted(df: DataFrame, how: str) -> DataFrame:
        parts = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
        return parts.agg(F.lit(how).alias("how"), F.sum("n").alias("cnt"), (F.max("n") <= F.sum("n") / 4).alias("even"), F.count("*").cast("int").alias("tasks"))

    rows = events(spark, sf_dir).select("event_id")
    return counted(partition.rebalance(rows, 8), "rebalance").unionByName(counted(partition.shuffle(rows, 8, 5), "shuffle"))


@query("task_ids", "SELECT event_type, count(*) AS cnt, count(*) AS ids, true AS own FROM events GROUP BY 1")
def task_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with ids that tasks give on their own: all differ, and the remainder by the number of tasks is the task's."""
    rows = partition.task_ids(partition.rebalance(events(spark, sf_dir).select("event_type"), 8), start=5).withColumn("task", F.spark_partition_id())
    own = F.bool_and(F.pmod(F.col("id") - 5, F.lit(8)) == F.col("task"))
    return rows.groupBy("event_type").agg(F.count("*").alias("cnt"), F.count_distinct("id").alias("ids"), own.alias("own"))


@query("salted_keys", "SELECT event_type, count(*) AS cnt, sum(value::DECIMAL(12,2))::DOUBLE AS total FROM events GROUP BY 1")
def salted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few hot keys in two steps: by key and a salt that is measured, then by key."""
    rows = events(spark, sf_dir).select("event_id", "event_type", F.col("value").cast("decimal(12,2)").alias("value"))
    plan = balance.measure(rows, ["event_type"], int(spark.conf.get("spark.sql.shuffle.partitions")))
    first = [F.count("*").alias("cnt"), F.sum("value").alias("total")]
    return balance.aggregate(rows, plan, ["event_id"], first, [F.sum("cnt").alias("cnt"), F.sum("total").cast("double").alias("total")])


@query(
    "balanced_join",
    "SELECT e.event_id, e.event_type, u.users FROM events e JOIN (SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1) u USING (event_type) WHERE e.value > 90",
)
def balanced_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on a few hot keys, whose rows are dealt over the tasks by measured salts."""
    rows = events(spark, sf_dir).select("event_id", "event_type", "value")
    users = events(spark, sf_dir).groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    plan = balance.measure(rows, ["event_type"], int(spark.conf.get("spark.sql.shuffle.partitions")))
    return balance.join(rows.where("value > 90").drop("value"), users, plan, ["event_id"])


def _key_groups(values: pd.Series) -> pd.Series:
    """Key groups of whole numbers: Murmur 3 of the four bytes of the hash code with seed 0, then modulo 128."""
    m = np.uint32
    rotl = lambda x, n: (x << m(n)) | (x >> m(32 - n))
    with np.errstate(over="ignore"):
        v = values.to_numpy().astype(np.int64)
        k = (v ^ (v >> 32)).astype(np.uint32)  # the hash code of a long
        h = rotl(rotl(k * m(0xCC9E2D51), 15) * m(0x1B873593), 13) * m(5) + m(0xE6546B64)
        h ^= m(4)
        h = (h ^ (h >> m(16))) * m(0x85EBCA6B)
        h = (h ^ (h >> m(13))) * m(0xC2B2AE35)
        h = (h ^ (h >> m(16))).view(np.int32).astype(np.int64)
    return pd.Series((np.abs(np.where(h == -(1 << 31), 0, h)) % 128).astype(np.int32))


_M = "4294967296"
_KEY_GROUPS = f"""WITH u AS (SELECT DISTINCT user_id, user_id::UBIGINT AS k FROM events),
     a AS (SELECT user_id, (k * 3432918353) % {_M} AS k FROM u),
     b AS (SELECT user_id, ((((k << 15) % {_M}) | (k >> 17)) * 461845907) % {_M} AS k FROM a),
     c AS (SELECT user_id, xor(((((k << 13) % {_M}) | (k >> 19)) * 5 + 3864292196) % {_M}, 4::UBIGINT) AS h FROM b),
     d AS (SELECT user_id, (xor(h, h >> 16) * 2246822507) % {_M} AS h FROM c),
     e AS (SELECT user_id, (xor(h, h >> 13) * 3266489909) % {_M} AS h FROM d),
     f AS (SELECT user_id, xor(h, h >> 16)::BIGINT AS h FROM e),
     g AS (SELECT user_id, (abs(CASE WHEN h = 2147483648 THEN 0 WHEN h > 2147483648 THEN h - {_M} ELSE h END) % 128)::INTEGER AS key_group FROM f)
   SELECT user_id, key_group, (key_group * 4 // 128)::INTEGER AS subtask FROM g"""


@query("keygroup_assign", _KEY_GROUPS)
def keygroup_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by the subtask that their key group falls to: 128 groups over 4 subtasks."""
    groups = events(spark, sf_dir).select("user_id").distinct().select("user_id", F.pandas_udf(_key_groups, "int")("user_id").alias("key_group"))
    return groups.withColumn("subtask", F.floor(F.col("key_group") * 4 / 128).cast("int"))
