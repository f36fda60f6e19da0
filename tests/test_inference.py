"""Tails against table values, rank tests against brute force, Fisher's test on large counts."""

import random
from math import comb

from pyspark.sql import functions as F

from gridtally.functions import tails
from gridtally.operators import inference, stats

# Values of published tables, to their digits: x or t, degrees of freedom, probability.
CHI_SQUARE = [(3.841458820694124, 1, 0.05), (6.634896601021213, 1, 0.01), (18.307038053275146, 10, 0.05), (124.34211340400407, 100, 0.05), (0.004393, 1, 0.947155)]
STUDENT = [(12.706204736174707, 1, 0.05), (2.2281388519862735, 10, 0.05), (2.0422724563012378, 30, 0.05), (1.983971518523553, 100, 0.05), (63.65674116287158, 1, 0.01)]
NORMAL = [(1.959963984540054, 0.05), (-2.5758293035489004, 0.01), (0.0, 1.0), (6.0, 1.973175290075396e-9)]


def test_tails(spark):
    chi = spark.createDataFrame(CHI_SQUARE, "x double, df int, want double").withColumn("p", tails.chi_square_p(F.col("x"), F.col("df")))
    assert all(abs(r.p - r.want) < (1e-9 if r.x > 1 else 1e-6) for r in chi.collect())
    t = spark.createDataFrame(STUDENT, "x double, df int, want double").withColumn("p", tails.t_p(F.col("x"), F.col("df")))
    assert all(abs(r.p - r.want) < 1e-9 for r in t.collect())
    q = spark.createDataFrame(STUDENT[:4], "x double, df int, want double").withColumn("q", tails.t_quantile(0.05, F.col("df")))
    assert all(abs(r.q - r.x) < 1e-9 * r.x for r in q.collect())
    z = spark.createDataFrame(NORMAL, "x double, want double").withColumn("p", tails.normal_p(F.col("x")))
    assert all(abs(r.p - r.want) < 1e-9 * max(r.want, 1e-3) for r in z.collect())
    odd = spark.createDataFrame([(None, 3), (float("inf"), 3), (1.0, 0), (float("nan"), 3)], "x double, df int").select(tails.t_p(F.col("x"), F.col("df")), tails.chi_square_p(F.col("x"), F.col("df")))
    assert [r[0] for r in odd.collect()] == [None, 0.0, None, None]


def test_large_degrees_of_freedom(spark):
    """The normal distribution is the limit, and half of chi-square lies near its degrees of freedom."""
    r = spark.range(1).select(tails.t_p(F.lit(1.959963984540054), F.lit(10**8)).alias("t"), tails.chi_square_p(F.lit(99_999.3333), F.lit(100_000)).alias("c")).first()
    assert abs(r.t - 0.05) < 1e-8 and abs(r.c - 0.5) < 1e-5


def test_rank_test_as_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice("abc"), float(rng.randint(0, 12)) if k else rng.random()) for k in range(2) for _ in range(120)] + [(0, "a", None), (2, "a", 1.0), (2, "b", 1.0), (3, "a", 1.0)]
    got = {r.k: r for r in inference.kruskal_wallis(spark.createDataFrame(rows, "k long, g string, v double").repartition(7), "k", "g", "v").collect()}
    for k in range(2):
        own = [(g, v) for i, g, v in rows if i == k and v is not None]
        n, values = len(own), [v for _, v in own]
        rank = {v: sum(x < v for x in values) + (values.count(v) + 1) / 2 for v in set(values)}
        sums = {g: [rank[v] for h, v in own if h == g] for g in "abc"}
        h = 12 / (n * (n + 1)) * sum(sum(x) ** 2 / len(x) for x in sums.values()) - 3 * (n + 1)
        h /= 1 - sum(values.count(v) ** 3 - values.count(v) for v in set(values)) / (n**3 - n)
        assert got[k].n == n and abs(got[k].h - h) < 1e-9 and abs(got[k].p - 2.718281828459045 ** (-h / 2)) < 1e-9
    assert got[2].h is None and got[3].h is None and got[3].p is None


def test_burden_without_error(spark):
    rows = [("line", float(i), 2.0 * i) for i in range(5)] + [("two", 0.0, 1.0), ("two", 1.0, 3.0)]
    got = {r.k: r for r in inference.burden_test(spark.createDataFrame(rows, "k string, x double, y double"), "k", "x", "y").collect()}
    assert got["line"].beta == 2.0 and got["line"].p < 1e-9 and got["two"].p is None and got["two"].low is None


def test_fisher_on_large_counts(spark):
    def brute(a, b, c, d):
        r1, c1, n = a + b, a + c, a + b + c + d
        p = [comb(r1, k) * comb(n - r1, c1 - k) for k in range(max(0, c1 - (n - r1)), min(r1, c1) + 1)]
        return sum(x for x in p if x <= comb(r1, a) * comb(n - r1, c1 - a)) / comb(n, c1)

    tables = [(3, 1, 1, 3), (0, 0, 0, 0), (5, 0, 0, 5), (0, 7, 4, 1), (40, 60, 55, 45), (200, 300, 250, 310), (10, 0, 3, 0)]
    got = stats.fisher_exact(spark.createDataFrame(tables + [(10**7, 10**7, 10**7, 10**7 + 9)], "a long, b long, c long, d long")).collect()
    for r, t in zip(got, tables):
        assert abs(r.p - brute(*t)) < 1e-9
    assert got[-1].p > 0.99
