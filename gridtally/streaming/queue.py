"""An action log kept by a stream: each batch once, whatever is replayed, and the latest entry of each key with an expiry.

The log has a folder a batch, named by the batch's id, that a replay of the batch writes anew, so nothing is appended twice and nothing that is read is
changed. The index is the latest entry of each key over a snapshot and the batches behind it; compaction writes a new snapshot beside the old one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from gridtally.sources.sinks import _exists
from gridtally.streaming.log import latest


def write_batch(batch: DataFrame, batch_id: int, root: str) -> None:
    """One batch of the log. Writing it again replaces it."""
    batch.write.mode("overwrite").parquet(f"{root}/log/batch_id={batch_id}")


def append_once(stream: DataFrame, root: str, checkpoint: str, **trigger):
    """Starts a query that appends a stream to the log below root; by default it takes what is there and ends."""
    return stream.writeStream.foreachBatch(lambda batch, i: write_batch(batch, i, root)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers of a folder's complete parts, ascending."""
    if not _exists(spark, folder):
        return []
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(path)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{name}=") and _exists(spark, f"{folder}/{n}/_SUCCESS"))


def log(spark: SparkSession, root: str, schema: StructType, after: int = -1) -> DataFrame:
    """The log's rows with their batch_id, of batches behind `after`; only those are read."""
    folders = [f"{root}/log/batch_id={i}" for i in _numbers(spark, f"{root}/log", "batch_id") if i > after]
    full = StructType([*schema.fields, StructField("batch_id", LongType())])
    if not folders:
        return spark.createDataFrame([], full)
    return spark.read.option("basePath", f"{root}/log").schema(full).parquet(*folders)


def index(spark: SparkSession, root: str, schema: StructType, key: list[str], order: list[str]) -> DataFrame:
    """The latest entry of each key: of the newest snapshot and the batches behind it."""
    upto = _numbers(spark, f"{root}/snapshot", "upto")
    rows = log(spark, root, schema, upto[-1] if upto else -1).drop("batch_id")
    if upto:
        rows = rows.unionByName(spark.read.schema(schema).parquet(f"{root}/snapshot/upto={upto[-1]}"))
    return latest(rows, key, order).select(*schema.names)


def compact(spark: SparkSession, root: str, schema: StructType, key: list[str], order: list[str]) -> int | None:
    """Writes the index as a snapshot up to the last batch, and gives that batch; None without any new one."""
    batches, upto = _numbers(spark, f"{root}/log", "batch_id"), _numbers(spark, f"{root}/snapshot", "upto")
    if not batches or (upto and upto[-1] >= batches[-1]):
        return None
    index(spark, root, schema, key, order).write.mode("overwrite").parquet(f"{root}/snapshot/upto={batches[-1]}")
    return batches[-1]


STATE = StructType([StructField("entry", StringType()), StructField("at", TimestampType())])


def latest_with_expiry(stream: DataFrame, key: str, at: str, late: str, keep_seconds: int) -> DataFrame:
    """(key, at, entry, event) of a stream: an 'update' for each key whose latest entry (as JSON) a batch changed, an 'expired' once nothing came for keep_seconds.

    Only keys within that time are held, so state follows the keys that live, not all that ever came. Time is that of the
    events; entries later than `late` are dropped. Of a key's entries at one time the greatest JSON counts.
    """
    others = F.to_json(F.struct(*(c for c in stream.columns if c != key)))
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(at).alias("at"), others.alias("entry")).withWatermark("at", late)
    out = StructType([StructField("key", StringType()), StructField("at", TimestampType()), StructField("entry", StringType()), StructField("event", StringType())])

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            entry, when = state.get
            state.remove()
            yield pd.DataFrame({"key": [k[0]], "at": [when], "entry": [entry], "event": ["expired"]})
            return
        best = (pd.Timestamp(state.get[1]), state.get[0]) if state.exists else None
        held = best
        for f in frames:
            newest = max(zip(f["at"], f["entry"]), default=best)
            best = newest if best is None else max(best, newest)
        if best != held:
            state.update((best[1], best[0].to_pydatetime()))
            yield pd.DataFrame({"key": [k[0]], "at": [best[0]], "entry": [best[1]], "event": ["update"]})
        until = int(best[0].timestamp() * 1000) + keep_seconds * 1000
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))

    return rows.groupBy("key").applyInPandasWithState(step, out, STATE, "append", GroupStateTimeout.EventTimeTimeout)
