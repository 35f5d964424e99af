"""Interval send of a stream, batch by batch, against a replay row by row and the SQL."""

from __future__ import annotations

import random

import duckdb
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_throttle import replay

from tidewheel.plans.catalog import ORACLES, QUERIES
from tidewheel.session import shared_dir
from tidewheel.sinks import committed
from tidewheel.streaming.sending import IntervalSends


def begun(spark, delay_us=0):
    return IntervalSends(shared_dir(spark, "sends-test"), "k", "o", "v", 20, delay_us)


def put(spark, sends, number, rows):
    """rows: (o, k, us, v)."""
    sends(spark.createDataFrame(rows, "o long, k string, us long, v double").withColumn("ts", F.timestamp_micros("us")).repartition(2), number)


def plain(df):
    return sorted(((r.k, r.sent_us, r.v) for r in df.collect()), key=str)


@pytest.mark.parametrize("steps", [[0, 0, 1, 2, 5, 40], [0, 3, 30, -25, -70]])
def test_batches_send_what_a_replay_sends(spark, steps):
    """Also where times fall below the watermark, a batch has no rows, or a batch runs again."""
    rng, at, rows = random.Random(len(steps)), 1000, []
    for o in range(150):
        at = max(0, at + rng.choice(steps))
        rows.append((o, rng.choice(["a", "a", "b", "c", None]), at, float(o) if rng.random() < 0.9 else None))
    sends = begun(spark)
    for n, (a, b) in enumerate([(0, 30), (30, 31), (31, 31), (31, 90), (90, 150)]):
        for _ in range(2 if n in (0, 3) else 1):
            put(spark, sends, n, rows[a:b])
    want = [(k, *x) for k in {r[1] for r in rows} for x in replay([(us, 0, v) for _, q, us, v in rows if q == k], 20, False)]
    assert plain(sends.results(spark, ended=True)) == sorted(want, key=str)


def test_the_watermark_sends_and_later_rows_correct(spark):
    """Keys keep one interval each, however many batches there are; what was sent once is not sent again without need."""
    sends, sent = begun(spark, delay_us=5), lambda: committed.read(spark, f"{sends.top}/sent").count()
    put(spark, sends, 0, [(0, "a", 100, 1.0), (1, "b", 124, 2.0)])
    assert plain(sends.results(spark)) == []
    put(spark, sends, 1, [(2, "b", 125, 3.0)])
    assert plain(sends.results(spark)) == [("a", 120, 1.0)]
    put(spark, sends, 2, [(3, "b", 126, 4.0)])
    assert sent() == 1
    put(spark, sends, 3, [(4, "a", 119, 5.0)])
    assert plain(sends.results(spark)) == [("a", 120, 5.0)] and sent() == 2
    put(spark, sends, 4, [(5, "a", 120, 6.0)])
    assert plain(sends.results(spark, ended=True)) == [("a", 120, 5.0), ("a", 140, 6.0), ("b", 144, 4.0)]
    assert sent() == 2 and committed.read(spark, f"{sends.top}/open", first=4).count() == 2
    assert committed.numbers(f"{sends.top}/open") == [3, 4]


def test_the_query_on_copies_whose_times_begin_again(spark, tmp_path):
    """Copies of the table with keys of their own: no row is late for its key."""
    duck = duckdb.connect()
    duck.sql(f"CREATE TABLE events AS SELECT * REPLACE (event_id + 1000 * i AS event_id, user_id + 15 * i AS user_id) FROM '{SMALL}/events.parquet', range(4) r(i)")
    duck.sql(f"COPY (SELECT * EXCLUDE i FROM events) TO '{tmp_path}/events.parquet'")
    got = QUERIES["stream_interval_send_lazy"](spark, str(tmp_path)).collect()
    want = duck.sql(f"SELECT user_id, sent_ms, v FROM ({ORACLES['stream_interval_send_lazy']})").fetchall()
    assert sorted((r.user_id, r.sent_ms, r.v) for r in got) == sorted(want)
