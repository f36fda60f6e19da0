"""The driver's tables seen as the inputs of the operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 30 days of seconds: the length of each chromosome of the event table.
CHROM_SIZE = 2_592_000

#: Rows of lineitem that a task of `dosages` by site counts.
LINES_PER_TASK = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites from events: type as chromosome, seconds into January 2024 (from 1) as position, user as sample."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("chrom"), (F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") + 1).cast("long").alias("pos"), F.col("event_id").alias("site_id"), F.col("user_id").alias("sample"), "value", ((F.col("event_id") % 101) / 100).alias("hwe_freq"), ((F.col("event_id") % 21 - 10) / 10).alias("f"))


def chrom_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("chrom")).distinct().withColumn("chrom_size", F.lit(CHROM_SIZE).cast("long"))


def dosages(spark: SparkSession, sf_dir: str, by_site: bool = False) -> DataFrame:
    """Calls from lineitem: part as site, supplier as sample, orders less one (2 at most) as dosage.

    by_site: a site's rows meet before they are counted, so that what goes by site afterwards isn't shuffled again, in as many tasks as the rows ask for.
    """
    lines = table(spark, sf_dir, "lineitem")
    if by_site:
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(lines.count() / LINES_PER_TASK))
        lines = lines.select("l_partkey", "l_suppkey").repartition(tasks, "l_partkey")
    counts = lines.groupBy(F.col("l_partkey").alias("site"), F.col("l_suppkey").alias("sample")).agg(F.count("*").alias("n"))
    return counts.select("site", "sample", F.least(F.lit(2), F.col("n") - 1).cast("int").alias("dosage"), F.concat(F.lit("g"), (F.col("sample") % 2).cast("string")).alias("group_name"))


def order_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals from orders: the customer's nation as chromosome, 30 days from the order's day, the order as id."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    start = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    return o.select(F.concat(F.lit("LG"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("chrom"), start.alias("start"), (start + 30).alias("end"), F.col("o_orderkey").alias("interval_id"), (F.col("o_totalprice") / 1000).alias("band_score"), "o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
