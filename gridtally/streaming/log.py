"""Append-only logs: the latest entry per key, lifecycle, request dedupe, cache eviction; batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def latest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last entry of each key; works on a stream too (update or complete mode)."""
    others = [c for c in log.columns if c not in key]
    rows = log.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_x"))
    return rows.select(*key, *(F.col(f"_x.{c}").alias(c) for c in others))


def evicted(entries: DataFrame, budget: int) -> DataFrame:
    """Entries (entry, bytes, used_at) with kept: the most recently used whose running size stays in the budget.

    The running sum starts from sums of whole days, so no task orders all entries.
    """
    days = entries.withColumn("_day", F.to_date("used_at"))
    sums = days.groupBy("_day").agg(F.sum("bytes").alias("_b"))
    after = sums.select("_day", F.coalesce(F.sum("_b").over(Window.orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum("bytes").over(Window.partitionBy("_day").orderBy(F.desc("used_at"), "entry").rowsBetween(Window.unboundedPreceding, 0))
    placed = days.withColumn("_run", inside).join(F.broadcast(after), "_day")
    return placed.withColumn("running", F.col("_run") + F.col("_before")).withColumn("kept", F.col("running") <= budget).drop("_day", "_run", "_before")


def dedupe_in_flight(requests: DataFrame, seconds: int) -> DataFrame:
    """Adds leader: true where no equal request (key) came within the seconds before."""
    w = Window.partitionBy("key").orderBy("ts", "request_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    return requests.withColumn("leader", F.coalesce(gap > seconds * 1_000_000, F.lit(True)))


def surviving(events: DataFrame) -> DataFrame:
    """Of each slot's events only the one of the greatest generation; the others were cancelled by it."""
    return latest(events, ["slot"], ["generation"])


def log_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stream of JSON lines that are appended as files to a folder."""
    return spark.readStream.schema(schema).json(path)


def keep_latest(stream: DataFrame, key: list[str], order: list[str], name: str, checkpoint: str):
    """Starts a query that holds the latest entry of each key in the in-memory table `name`, for what has come so far."""
    return latest(stream, key, order).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_stream(stream: DataFrame, key: list[str], ts: str, within: str) -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(key)
