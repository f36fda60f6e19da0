"""Tests with p-values: trends, regressions and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtally.functions.tails import chi_square_p, normal_p, t_p, t_quantile
from gridtally.operators.stats import armitage_trend, burden
from gridtally.session import checkpointed


def trend_test(rows: DataFrame, by: str) -> DataFrame:
    """The Cochran-Armitage trend of (dosage, affected) per group, with its two-sided p."""
    return armitage_trend(rows, by).withColumn("p", normal_p(F.col("z")))


def burden_test(rows: DataFrame, by: str, x: str, y: str, level: float = 0.95) -> DataFrame:
    """The regression of y on x per group with t, its two-sided p and the slope's confidence interval; null without an error or a degree of freedom.

    A slope without any error has an infinite t and p 0.
    """
    df = F.col("n") - 2
    t = F.when(F.col("se") > 0, F.col("beta") / F.col("se")).when((F.col("se") == 0) & (F.col("beta") != 0), F.signum("beta") * F.lit(float("inf")))
    out = burden(rows, by, x, y).withColumn("t", t).withColumns({"p": t_p(F.col("t"), df), "_half": t_quantile(1 - level, df) * F.col("se")})
    return out.withColumns({"low": F.col("beta") - F.col("_half"), "high": F.col("beta") + F.col("_half")}).drop("_half")


def mid_ranks(counts: DataFrame, by: str, value: str, n: str) -> DataFrame:
    """counts (a row for each by and value, n times) with before, the rows of smaller values, and of, all rows of its by.

    Values are sorted in ranges; what lies before a range comes from one row a range, so no group is one task.
    """
    ranged = counts.repartitionByRange(by, value).withColumn("_range", F.spark_partition_id())
    ranged = checkpointed(ranged)
    totals = ranged.groupBy(by, "_range").agg(F.sum(n).alias("_n"))
    whole = Window.partitionBy(by)
    offsets = totals.select(by, "_range", (F.sum("_n").over(whole.orderBy("_range")) - F.col("_n")).alias("_offset"), F.sum("_n").over(whole).alias("of"))
    within = F.sum(n).over(Window.partitionBy(by, "_range").orderBy(value)) - F.col(n)
    return ranged.withColumn("_within", within).join(offsets, [by, "_range"]).withColumn("before", F.col("_offset") + F.col("_within")).drop("_range", "_within", "_offset")


def kruskal_wallis(rows: DataFrame, by: str, group: str, value: str) -> DataFrame:
    """(by, n, groups, h, p): the rank test of equal places of the groups in each by, corrected for ties.

    Rows without a value or a group are left out. Counts per distinct value are all that is sorted, equal values sharing their mean rank;
    h is null where all values are equal, p also for fewer than two groups.
    """
    counts = checkpointed(rows.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(by, value, group).agg(F.count("*").alias("_n")))
    levels = mid_ranks(counts.groupBy(by, value).agg(F.sum("_n").alias("_t")), by, value, "_t")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    t = wide("_t")
    ties = levels.groupBy(by).agg(F.max("of").alias("n"), F.sum((t * t * t - t).cast("double")).alias("ties"))
    ranked = counts.join(levels.select(by, value, (2 * F.col("before") + F.col("_t") + 1).alias("_twice")), [by, value])
    sums = ranked.groupBy(by, group).agg((F.sum(wide("_twice") * wide("_n")).cast("double") / 2).alias("_r"), F.sum("_n").alias("_n"))
    squares = sums.groupBy(by).agg(F.sum(F.col("_r") * F.col("_r") / F.col("_n")).alias("squares"), F.count("*").alias("groups"))
    n = F.col("n").cast("double")
    spread = 1 - F.col("ties") / (n * n * n - n)
    h = F.when((n > 1) & (spread > 0), F.greatest(F.lit(0.0), (12 / (n * (n + 1)) * F.col("squares") - 3 * (n + 1)) / spread))
    return ties.join(squares, by).withColumn("h", h).select(by, "n", "groups", "h", chi_square_p(F.col("h"), F.col("groups") - 1).alias("p"))
