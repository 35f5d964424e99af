"""Ranks over ranges against window functions, with groups in several tasks, ties and nulls."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewheel.operators import ranks
from tidewheel.operators.names import fresh


def test_ranks_of_large_groups(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 8 + ["a", None]), rng.choice([None, *range(60)]), rng.randint(0, 2)) for i in range(1500)] + [(9000, "lone", 1, 1)]
    df = spark.createDataFrame(rows, "id long, k string, v int, __rn int")
    by = Window.partitionBy("k").orderBy("v", "id")
    want = df.select("*", F.row_number().over(by).cast("bigint").alias("n"), F.rank().over(Window.partitionBy("k").orderBy("v")).cast("bigint").alias("r"), F.dense_rank().over(Window.partitionBy("k").orderBy("v")).cast("bigint").alias("d"), F.ntile(7).over(by).cast("bigint").alias("t"), F.lag("v").over(by).alias("b"))
    whole = ranks.ranked(df, ["k"], ["v", "id"], row_number="n", ntile=("t", 7), before=("b", "v"), parts=9)
    tied = ranks.ranked(df, ["k"], ["v"], rank="r", dense="d", parts=9)
    take = lambda d, *names: sorted(map(str, d.select("id", "k", "v", "__rn", *names).collect()))
    assert take(whole, "n", "t", "b") == take(want, "n", "t", "b")
    assert take(tied, "r", "d") == take(want, "r", "d")
    assert ranks.ranked(df.limit(0), ["k"], ["v"], rank="r").count() == 0


def test_names_meet_no_column():
    assert fresh(["__V", "__v_"], "v", "v", "w") == ["__v__", "__v___", "__w"]
