"""Windows in ranges against plain windows, with a key of most rows, null keys and ties of values."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridtally.operators import ranges, rules


def test_as_plain_windows(spark):
    rng = random.Random(2)
    data = [(rng.choice(["hot"] * 8 + ["a", None]), i, rng.choice([None, 1, 2, 3])) for i in range(700)]
    rows = spark.createDataFrame(data, "k string, o long, v long")
    keys, order = ["k"], ["o"]
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # else so few rows make one range
    dealt = ranges.ranged(rows.repartition(5), keys, order)
    spark.conf.set(key, "true")
    assert dealt.filter("k = 'hot'").select(ranges.RANGE).distinct().count() > 1
    out = ranges.with_previous(dealt, keys, order, F.col("v"), "prior")
    out = ranges.with_running(out, keys, order, F.coalesce("v", F.lit(0)), "running")
    out = ranges.with_greatest_before(out, keys, order, "v", "reach")
    out = ranges.with_place(out, keys, order, "place", "of").withColumn("tile", ranges.tile(F.col("place"), F.col("of"), 7))
    got = out.select("k", "o", "prior.v", F.col("prior").isNull().alias("first"), "running", "reach", "place", "of", "tile")
    w = Window.partitionBy("k").orderBy("o")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = rows.select("k", "o", F.lag("v").over(w), F.row_number().over(w) == 1, F.sum(F.coalesce("v", F.lit(0))).over(w), F.max("v").over(before), F.row_number().over(w), F.count("*").over(Window.partitionBy("k")), F.ntile(7).over(w))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_thirds_of_ties(spark):
    data = [(k, i, v) for k, n in (("x", 50), (None, 7), ("one", 1), ("two", 2)) for i, v in enumerate([i // 9 for i in range(n)])]
    rows = spark.createDataFrame(data, "k string, id long, v long")
    w = Window.partitionBy("k")
    want = rows.select("k", "id", F.ntile(3).over(w.orderBy("v", "id")), F.percent_rank().over(w.orderBy("v")))
    got = rules.thirds(rows, "k", "v", "id").select("k", "id", "third", "rank_share")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
