"""Interval send by jumps against a replay row by row, in batches, blocks and streams."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_streams import Due, States

from tidewheel.operators import throttle
from tidewheel.streaming.state import IntervalSend


def replay(rows, interval, eager, round_to=1):
    """rows: (us, version, value) of one key in order. Sends as (us, value)."""
    due, held, out = None, None, []
    for us, version, v in [*rows, (None, None, None)]:
        if due is not None and (us is None or us >= due):
            if held is not None:
                out.append((due, held[1]))
            due, held = None, None
        if us is None:
            break
        if due is None:
            due = (us + interval) // round_to * round_to
            if eager:
                out.append((us, v))
                continue
        if held is None or version >= held[0]:
            held = (version, v)
    return sorted(out, key=str)


def made(seed, keys="abcde", n=400):
    """Times that mostly rise, stand still, fall a little, or jump ahead."""
    rng = random.Random(seed)
    at, rows = 0, []
    for o in range(n):
        at += rng.choice([0, 1, 2, 3, 30, 200]) if rng.random() < 0.9 else -5
        rows.append((o, rng.choice(keys) if rng.random() < 0.5 else keys[0], max(at, 0), rng.randint(0, 3), float(o) if rng.random() < 0.9 else None))
    return rows


def sent(spark, rows, interval, **options):
    df = spark.createDataFrame(rows, "o long, k string, us long, ver long, v double").withColumn("ts", F.timestamp_micros("us")).repartition(3)
    got = throttle.interval_send(df, "k", "o", "v", interval, **options)
    return sorted(((r.k, r.sent_us, r.v) for r in got.collect()), key=str)


@pytest.mark.parametrize(("eager", "round_us", "hot"), [(True, 1, 1 << 20), (False, 1, 1 << 20), (True, 7, 40), (False, 20, 11), (True, 1, 1), (False, 1, 3)])
def test_sends_against_a_replay(spark, eager, round_us, hot):
    for seed in range(2):
        rows = made(seed)
        for newer in (None, F.col("ver")):
            want = [(k, *x) for k in {r[1] for r in rows} for x in replay([(us, ver if newer is not None else 0, v) for _, q, us, ver, v in rows if q == k], 20, eager, round_us)]
            assert sent(spark, rows, 20, eager=eager, round_us=round_us, hot=hot, newer=newer) == sorted(want, key=str)


def test_sends_of_odd_tables(spark):
    rows = [(0, None, 5, 0, 1.0), (1, None, 6, 0, 2.0), (2, "a", 0, 0, None)]
    assert sent(spark, rows, 10) == sorted([("a", 0, None), (None, 5, 1.0), (None, 15, 2.0)], key=str)
    assert sent(spark, [], 10) == []
    with pytest.raises(ValueError):
        sent(spark, rows, 10, round_us=11)


def test_small_arrow_batches_and_a_key_in_many_tasks(spark):
    """A key of 20,000 rows in blocks of 1,500, and batches of 100 rows, give what one fold gives."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "100")
    try:
        rng = random.Random(9)
        at, rows = 0, []
        for o in range(20_000):
            at += rng.choice([0, 1, 2, 7])
            rows.append((o, "hot", at, 0, float(o)))
        want = [("hot", *x) for x in replay([(us, 0, v) for _, _, us, _, v in rows], 50, True)]
        assert sent(spark, rows, 50, hot=1500) == sent(spark, rows, 50) == sorted(want, key=str)
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize(("eager", "round_ms"), [(True, 1), (False, 1), (True, 15), (False, 15)])
def test_streams_send_what_batches_send(eager, round_ms):
    for seed in range(30):
        rng = random.Random(seed)
        at, rows = 0, []
        for o in range(rng.randint(1, 60)):
            at += rng.choice([0, 1, 2, 5, 40])
            rows.append((at, rng.randint(0, 2), float(o)))
        for newer in (None, "ver"):
            send, handle, out = IntervalSend(20, "ms", "v", eager, round_ms, newer), States(), []
            send.init(handle)
            cuts = sorted({0, len(rows), *[rng.randrange(len(rows)) for _ in range(4)]})
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                out += list(send.handleInputRows(("k",), iter([pd.DataFrame(rows[a:b], columns=["ms", "ver", "v"])]), None))
                mark = rows[b - 1][0] if b < len(rows) else 1 << 60
                for t in sorted(x for x in handle.timers if x <= mark):
                    handle.timers.discard(t)
                    out += list(send.handleExpiredTimer(("k",), None, Due(t)))
            got = sorted(((r.sent_ms, r.v) for part in out for r in part.itertuples()), key=str)
            assert got == replay([(us, ver if newer else 0, v) for us, ver, v in rows], 20, eager, round_ms)


def test_a_stream_keeps_one_state_for_a_key():
    send, handle = IntervalSend(20, "ms", "v", False), States()
    send.init(handle)
    list(send.handleInputRows(("k",), iter([pd.DataFrame([(1, 1.0), (2, 2.0)], columns=["ms", "v"])]), None))
    assert len(handle.values) == 1 and handle.timers == {21}
    assert next(iter(send.handleExpiredTimer(("k",), None, Due(21)))).values.tolist() == [["k", 21, 2.0]]
    assert not handle.values
