"""Queries on keys that many rows share: rows must not grow in their square, and results stay exact."""

import random

from pyspark.sql import functions as F

from gridtally.operators import intervals


def _dense(spark, seed, n=300, long=90):
    rng = random.Random(seed)
    points = [(i, rng.randrange(12), "a", rng.randrange(-50, 200)) for i in range(n)]
    spans = [(i, i - 1 if i % 2 else None, "a", s := rng.randrange(-60, 200), s + rng.randrange(long) - 1) for i in range(n)]
    return spark.createDataFrame(points, "point_id long, sample long, chrom string, pos long"), spark.createDataFrame(spans, "candidate_id long, parent_id long, chrom string, start long, end long"), points, spans


def test_blocks_make_up_an_interval(spark):
    _, _, _, spans = _dense(spark, 1)
    rows = intervals.dyadic_blocks(spark.createDataFrame(spans, "id long, parent long, chrom string, start long, end long")).collect()
    for i, _, _, s, e in spans:
        own = [r for r in rows if r.id == i]
        assert sorted(x for r in own for x in range(r._block << r._level, (r._block + 1) << r._level)) == list(range(s, e + 1))
        assert len(own) <= 2 * max(1, (e - s + 1).bit_length())


def test_smallest_containing_joins_places_not_pairs(spark):
    points, spans, rows, shapes = _dense(spark, 2)
    shapes_df = spans.select("chrom", "start", "end", F.col("candidate_id").alias("interval_id"))
    found = intervals.smallest_containing(points, shapes_df, 64, ["point_id"])
    want = {p: min((e - s, c) for c, _, _, s, e in shapes if s <= x <= e)[1] for p, _, _, x in rows if any(s <= x <= e for _, _, _, s, e in shapes)}
    assert {r.point_id: r.interval_id for r in found.collect()} == want
    assert "between" not in found._jdf.queryExecution().analyzed().toString().lower() and ">= start" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_ruled_labels_are_effective_labels_of_the_calls_that_the_rule_makes(spark):
    points, spans, _, _ = _dense(spark, 3)
    allowed, label = lambda s, c: (s + c) % 4 > 0, lambda s, c: F.concat(F.lit("l"), ((s + c) % 3).cast("string"))
    seen = intervals.points_in(points, spans, 64).select("sample", "candidate_id").distinct()
    calls = seen.filter(allowed(F.col("sample"), F.col("candidate_id"))).withColumn("label", label(F.col("sample"), F.col("candidate_id")))
    want = sorted(map(str, intervals.effective_labels(points, spans, calls, 64).collect()))
    assert sorted(map(str, intervals.ruled_labels(points, spans, 4, allowed, label).collect())) == want and len(want) > 100


def test_king_within_pairs_only_equals_and_deals_pairs_out(spark, monkeypatch):
    from gridtally.operators import stats

    rng = random.Random(4)
    calls = [(s, site, rng.randrange(3), s % 3) for s in range(24) for site in range(20) if rng.random() < 0.8]
    df = spark.createDataFrame(calls, "sample long, site long, dosage int, nation long")
    every = {(r.a, r.b): r for r in stats.king(df).collect()}
    got = {(r.a, r.b): r for r in stats.king(df, within=["nation"]).collect()}
    assert got == {k: v for k, v in every.items() if k[0] % 3 == k[1] % 3} and len(got) == 84
    # pairs at a site in hundreds: so many tasks, whatever the session's number
    monkeypatch.setattr(stats, "PAIRS_PER_TASK", 100)
    many = stats.king(df)
    assert "RepartitionByExpression [a#" in many._jdf.queryExecution().optimizedPlan().toString() and many.rdd.getNumPartitions() > 30
    assert {(r.a, r.b): r for r in many.collect()} == every


def test_estimands_join_no_rows_without_a_kind(spark):
    """As equal keys of an outer join such rows would all meet in one task."""
    from gridtally.operators import states

    asked = spark.createDataFrame([(i,) for i in range(6)], "estimand long")
    rows = [(0, None, None, True), (1, "product", 1, True), (1, None, None, True), (2, "product", None, False), (3, "layer", 9, True), (4, "sample_attribute", None, True)]
    wanted = spark.createDataFrame(rows, "estimand long, kind string, id long, required boolean")
    found = states.estimands(asked, wanted, spark.createDataFrame([(1, "ready")], "product long, state string"), spark.createDataFrame([(1, "RESOLVED")], "layer long, state string"), spark.createDataFrame([(1, "known")], "attribute long, status string"))
    assert {r.estimand: r.state for r in found.collect()} == {0: "estimable", 1: "estimable", 2: "partially_estimable", 3: "not_estimable", 4: "needs_extra_data", 5: "not_estimable"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(kind#" in plan and "Union" in plan
