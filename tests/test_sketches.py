"""States of distinct counts, quantiles and bitmaps: forms, merges, and bounds on errors."""

from __future__ import annotations

import math
import random
import struct
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import bitmaps, distinct, quantiles, states


def hashes(n, seed=0):
    return np.random.default_rng(seed).integers(-(1 << 63), (1 << 63) - 1, n, np.int64)


def of(sketch, values):
    return sketch.of(pa.array(values))


# distinct counts


@pytest.mark.parametrize("p", [4, 6, 10, 12, 14])
def test_registers_pack_and_unpack(p):
    r = np.random.default_rng(p).integers(0, 64, 1 << p).astype(np.uint8)
    packed = distinct.pack(r)
    assert len(packed) == 6 * (1 << p) // 8 and distinct.unpack(packed).tolist() == r.tolist()
    bits = int.from_bytes(packed, "little")
    assert all(bits >> 6 * i & 63 == r[i] for i in range(0, 1 << p, 7))


def test_forms_of_a_distinct_state():
    s = distinct.Distinct(12)
    few, some, many = (of(s, hashes(n)) for n in (16, 128, 129))
    assert few[:2] == bytes([1, 16]) and len(few) == 2 + 16 * 8
    assert some[:3] == bytes([2, 0x80, 0x01]) and len(some) == 3 + 128 * 8
    assert many[0] == 3 and len(many) == 1 + 3072 + 54 * 4 + 2
    zeros = int((distinct.unpack(many[1:3073]) == 0).sum())
    assert struct.unpack_from("<I", many, 3073)[0] == zeros == struct.unpack("<H", many[-2:])[0]
    assert s.count(few) == 16 and s.count(some) == 128 and abs(s.count(many) - 129) < 10
    assert of(s, np.zeros(0, np.int64)) == b"\x01\x00" and s.count(b"\x01\x00") == 0
    with pytest.raises(ValueError):
        s.count(b"\x09")


def test_a_rank_is_from_the_low_zeros():
    s = distinct.Distinct(12, exact=0)
    values = np.array([5 | 1 << 12, 5 | 1 << 20, 7, 9 | 3 << 13], np.int64)
    r = s.registers(of(s, values))
    assert (r[5], r[7], r[9]) == (9, 53, 2) and r.sum() == 64


@pytest.mark.parametrize("sizes", [(3, 4), (100, 20), (100, 60), (500, 3), (3000, 4000), (0, 5)])
def test_merges_are_what_one_state_of_all_is(sizes):
    for p in (12, 14):
        s, every = distinct.Distinct(p), hashes(sum(sizes), 7)
        parts = [of(s, np.concatenate([every[: sizes[0]], every[:3]])), of(s, every[sizes[0] - min(2, sizes[0]) :])]
        whole = of(s, np.concatenate([every, every[:3]]))
        assert s.merge(parts) == s.merge(parts[::-1]) == s.merge([s.merge(parts), parts[0]]) == whole


def test_errors_of_estimates_from_registers():
    """Within three standard errors, from ten to ten million, without tables of corrections."""
    s, held, done = distinct.Distinct(14, exact=0), None, 0
    for n in (10, 100, 1000, 10_000, 30_000, 50_000, 100_000, 1_000_000, 10_000_000):
        new = of(s, hashes(n - done, n))
        held, done = new if held is None else s.merge([held, new]), n
        assert abs(s.count(held) - n) <= max(1, n * 3 * 1.04 / math.sqrt(1 << 14)), n


def test_hours_and_days_of_distinct_users(spark):
    """Three users in each hour, four in each day, from states of hours."""
    rows = [(datetime(2024, 1, day, hour), user) for day, names in ((25, "1234"), (26, "abcd")) for hour, pick in ((13, names[:3]), (14, names[0] + names[2:])) for user in pick]
    df = spark.createDataFrame([*rows, (datetime(2024, 1, 25, 13), ""), (datetime(2024, 1, 25, 14), None)], "ts timestamp_ntz, user string")
    hours = distinct.distinct_states(df, ["ts"], "user")
    assert [r.approx_distinct for r in distinct.counted(hours).collect()] == [3, 3, 3, 3]
    days = states.merged(hours.withColumn("day", F.to_date("ts")), ["day"], distinct.Distinct())
    assert [r.approx_distinct for r in distinct.counted(days).collect()] == [4, 4]
    assert distinct.counted(states.merged(hours, [], distinct.Distinct())).first().approx_distinct == 8
    registers = distinct.Distinct(12, exact=0)
    assert [r.approx_distinct for r in distinct.counted(distinct.distinct_states(df, ["ts"], "user", registers), registers).collect()] == [3, 3, 3, 3]


def test_states_of_many_groups(spark, monkeypatch):
    """Several key columns, null keys, and tasks that put their states out again and again."""
    df = spark.range(3000).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("b"), (F.col("id") % 100).alias("v")).repartition(3)
    monkeypatch.setattr(states, "HELD", 0)
    got = {(r.a, r.b): r.approx_distinct for r in distinct.counted(distinct.distinct_states(df, ["a", "b"], "v")).collect()}
    want = {(r.a, r.b): r.n for r in df.groupBy("a", "b").agg(F.count_distinct("v").alias("n")).collect()}
    assert got == want and len(want) == 21
    assert distinct.distinct_states(df.limit(0), ["a"], "v").count() == 0


# quantiles


def states_of(spark, values, most=2048, parts=1):
    df = spark.createDataFrame([(i % parts, v) for i, v in enumerate(values)], "part int, v double")
    got = quantiles.quantile_states(df, ["part"], "v", 0.01, most)
    return got if parts == 1 else quantiles.merge_quantiles(got, [], most)


def test_quantiles_of_any_sign(spark):
    rng = random.Random(5)
    values = [rng.choice([-1, 1]) * 10 ** rng.uniform(-6, 6) for _ in range(4000)] + [0.0] * 300 + [-7.0]
    values += [None, math.nan]
    qs = [0.0, 0.01, 0.2, 0.48, 0.5, 0.52, 0.7, 0.99, 1.0]
    true = sorted(v for v in values if v is not None and v == v)
    for parts in (1, 5):
        got = {r.q: r.estimate for r in quantiles.quantiles(states_of(spark, values, parts=parts), [], qs).collect()}
        for q in qs:
            want = true[math.floor(q * (len(true) - 1))]
            assert abs(got[q] - want) <= 0.01001 * abs(want), q


def test_bins_are_bounded_from_the_lowest(spark):
    values = [1.05**i for i in range(400)] + [-(1.05**i) for i in range(400)] + [0.0]
    one, merged = states_of(spark, values, 50).first(), states_of(spark, values, 50, 4).first()
    assert one.bins == merged.bins and (one.low, one.high) == (merged.low, merged.high) == (min(values), max(values))
    assert sum(b.n for b in one.bins) == 801 and max(sum(b.sign == s for b in one.bins) for s in (-1, 1)) <= 50
    got = {r.q: r.estimate for r in quantiles.quantiles(states_of(spark, values, 50), [], [0.0, 0.01, 0.5, 0.99, 1.0]).collect()}
    assert got[0.5] == 0 and all(abs(got[q] - w) <= 0.0101 * abs(w) for q, w in ((0.0, values[799]), (0.01, -(1.05**391)), (0.99, 1.05**391), (1.0, values[399])))


def test_quantiles_of_odd_numbers(spark):
    got = {r.q: r.estimate for r in quantiles.quantiles(states_of(spark, [math.inf, -math.inf, 5e-324, 0.0, -0.0], 1 << 17), [], [0.0, 0.25, 0.75, 1.0]).collect()}
    assert got[0.0] < -1e308 and got[0.25] == 0 and 0 <= got[0.75] < 1e-300 and got[1.0] > 1e308
    assert states_of(spark, [None, math.nan]).count() == 0


# bitmaps


def bitmap_of(values):
    return bitmaps.Bitmap().of(pa.array(values, pa.int64()))


def numbers(data):
    return [h << 16 | int(x) for h, low in bitmaps.load(data).items() for x in low]


def test_the_portable_form():
    """Array, run and bitmap containers, byte by byte."""
    assert bitmap_of([1, 5, 70_000]) == struct.pack("<II4H2I", 12346, 2, 0, 1, 1, 0, 24, 28) + struct.pack("<3H", 1, 5, 70_000 - 65_536)
    assert bitmap_of(range(10, 1000)) == struct.pack("<IB2H3H", 12347, 1, 0, 989, 1, 10, 989)
    odd = bitmap_of(range(0, 20_000, 2))
    assert len(odd) == 8 + 4 + 4 + 8192 and odd[16:20] == b"\x55" * 4
    assert bitmap_of([]) == struct.pack("<II", 12346, 0) and bitmaps.cardinality(bitmap_of([])) == 0


def test_bitmaps_hold_what_they_were_given():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 32, 3000), rng.integers(0, 1 << 17, 30_000), np.arange(100_000, 400_000), np.concatenate([np.arange(5000), rng.integers(0, 1 << 20, 9000)]), np.array([0, (1 << 32) - 1]), np.arange(0, 1 << 18, 3)]
    sets = [set(x.tolist()) for x in sets]
    dumped = [bitmap_of(sorted(x)) for x in sets]
    for x, data in zip(sets, dumped, strict=True):
        assert numbers(data) == sorted(x) and bitmaps.cardinality(data) == len(x)
    for i in range(len(sets)):
        for j in range(i):
            assert bitmaps.Bitmap().merge([dumped[i], dumped[j]]) == bitmap_of(sorted(sets[i] | sets[j]))
            assert bitmaps.both([dumped[i], dumped[j]]) == bitmap_of(sorted(sets[i] & sets[j]))
    assert bitmaps.Bitmap().merge(dumped) == bitmap_of(sorted(set().union(*sets)))
    with pytest.raises(ValueError):
        bitmap_of([-1])


def test_sparse_bitmaps_are_small(spark):
    """Ids far from each other: a fixed bitmap takes 4 KB for each, a container a few bytes."""
    df = spark.range(200).select((F.col("id") * 10_000_019).alias("v"), F.lit(1).alias("k"))
    got = bitmaps.counted(bitmaps.bitmaps(df, ["k"], "v")).first()
    fixed = df.groupBy("k", F.bitmap_bucket_number("v")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("b")).agg(F.sum(F.length("b"))).first()[0]
    assert got.distinct_values == 200 and len(got.bitmap) * 100 < fixed


def test_hours_of_many_users_as_the_sql_states(spark, tmp_path):
    import duckdb

    from tidewheel.plans.catalog import ORACLES, QUERIES

    hours = F.expr("TIMESTAMP_NTZ '2024-01-01 00:10:00' + make_interval(0, 0, 0, 0, cast(hour AS int))").alias("ts")
    # 384 and 385 users, thousands, one, null alone; each row twice, and negative and very large numbers among the users
    sizes = spark.createDataFrame([(0, 384), (1, 385), (2, 3000), (3, 60_000), (4, 1)], "hour long, n long")
    users = sizes.select(hours, F.explode(F.sequence(F.lit(1), "n")).alias("i")).withColumn("user_id", F.col("i") * F.when(F.col("i") % 3 == 0, -1).otherwise(10**12 + 7))
    users = users.drop("i").union(spark.range(5, 6).select(F.col("id").alias("hour")).select(hours, F.lit(None).cast("long")))
    users.union(users).repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.win_start, r.approx_distinct) for r in QUERIES["hll_hour"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == set(con.sql(ORACLES["hll_hour"]).fetchall()) and len(got) == 6
    counts = [n for _, n in sorted(got)]
    assert counts[0] == 384 and counts[4:] == [1, 0]
    assert all(abs(n - k) <= 3 * 1.04 / 64 * k for n, k in zip(counts[1:4], (385, 3000, 60_000), strict=True))
