"""Cleaning up after a candidate's segments are recomputed: what went stale, in counts first, then by rewriting only the partitions that it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtally.session import checkpointed
from gridtally.sources.sinks import _exists

SCALES = ("seg", "seg_dco")
#: The tables below a registry's root, each in one partition a candidate, and what their rows are called in a report.
TABLES = {"segments": "candidates", "groups": "groups", "manifest": "manifest_rows"}


def stale_segments(segments: DataFrame, breakpoints: DataFrame) -> DataFrame:
    """(cid, segment_id) of segments (cid, segment_id, scale, start, end) of a segment's scale, one of whose ends isn't among the candidate's breakpoints (cid, position) any more.

    Only candidates that have been recomputed, so have breakpoints, are looked at.
    """
    ends = segments.filter(F.col("scale").isin(*SCALES)).join(breakpoints.select("cid").distinct(), "cid", "left_semi")
    each = ends.select("cid", "segment_id", F.explode(F.array("start", "end")).alias("position"))
    return each.join(breakpoints.select("cid", "position"), ["cid", "position"], "left_anti").select("cid", "segment_id").distinct()


def report(stale: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(cid, candidates, groups, manifest_rows): how many rows of each table (cid, segment_id, ...) would go, for each candidate that has any."""
    out = None
    for name, what in TABLES.items():
        count = tables[name].join(stale, ["cid", "segment_id"], "left_semi").groupBy("cid").agg(F.count("*").alias(what))
        out = count if out is None else out.join(count, "cid", "full")
    return out.na.fill(0)


def collect(spark: SparkSession, root: str, breakpoints: DataFrame, stamp: str, dry_run: bool = True) -> DataFrame:
    """The report of root's tables; unless it is a dry run, their stale rows are moved to root/_archive/stamp.

    Rows are archived before they go, and archived again alike if a run is repeated after a failure. Partitions of
    candidates without stale rows keep their files; a partition of which nothing is left is deleted.
    """
    tables = {name: spark.read.parquet(f"{root}/{name}") for name in TABLES}
    stale = checkpointed(stale_segments(tables["segments"], breakpoints))
    counts = checkpointed(report(stale, tables))
    if dry_run:
        return counts
    # segments go last: they say what is stale, so a run that broke off can be run again
    for name in reversed(TABLES):
        rows = tables[name]
        gone = rows.join(stale, ["cid", "segment_id"], "left_semi")
        touched = checkpointed(gone.select("cid").distinct())
        if touched.isEmpty():
            continue
        gone.write.mode("overwrite").parquet(f"{root}/_archive/{stamp}/{name}")
        kept = checkpointed(rows.join(touched, "cid", "left_semi").join(stale, ["cid", "segment_id"], "left_anti"))
        kept.select(*rows.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cid").parquet(f"{root}/{name}")
        for r in touched.join(kept.select("cid").distinct(), "cid", "left_anti").toLocalIterator():
            _delete(spark, f"{root}/{name}", r.cid)
    return counts


def _delete(spark: SparkSession, table: str, cid) -> None:
    jvm = spark.sparkContext._jvm
    name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(cid))
    path = jvm.org.apache.hadoop.fs.Path(f"{table}/cid={name}")
    if _exists(spark, f"{table}/cid={name}"):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
