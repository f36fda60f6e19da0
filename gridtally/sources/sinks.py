"""Writers with the checks that come before them."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtally.operators.registry import missing_references

#: The folders below a project that may be written.
WRITABLE = ("layers/", "actions/")


def write_tsv(frame: DataFrame, path: str, columns: list[str]) -> None:
    """Tab-separated part files of the given columns in their order, each with a header, quoted only where needed."""
    frame.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns)).write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def append_results(new: DataFrame, path: str, row_id: str, references: list[tuple[str, DataFrame, str]]) -> None:
    """Appends rows after checking their references and that their ids are new; refuses all if any fails."""
    spark = new.sparkSession
    if not (bad := missing_references(new, row_id, references)).isEmpty():
        raise ValueError(f"unknown references: {[tuple(r) for r in bad.orderBy('row_id', 'column').limit(5).collect()]}")
    if not new.groupBy(row_id).count().filter("count > 1").isEmpty():
        raise ValueError("an id occurs twice")
    if _exists(spark, path) and not new.join(spark.read.parquet(path).select(row_id), row_id, "left_semi").isEmpty():
        raise ValueError("an id is taken")
    new.write.mode("append").parquet(path)


def write_envelopes(envelopes: DataFrame, root: str, action_id: str, folder: str = "layers") -> None:
    """Layer envelopes by type and dataset below a folder of root that may be written; those without an action get this one."""
    stamped = envelopes.withColumn("action_id", F.coalesce("action_id", F.lit(action_id)))
    stamped.write.mode("append").partitionBy("layer_type", "dataset_id").parquet(target(root, folder))


def append_rows(rows: DataFrame, root: str, folder: str) -> str:
    """Appends rows of a log or an index to a folder of root that may be written, and gives its place."""
    place = target(root, folder)
    rows.write.mode("append").json(place)
    return place


def write_queue(manifests: DataFrame, root: str) -> DataFrame:
    """Appends manifests to the queue and writes its index anew; gives the index: one row an action, its last manifest by submitted_at."""
    spark = manifests.sparkSession
    queued = spark.read.schema(manifests.schema).json(append_rows(manifests, root, "actions/queue"))
    columns = [c for c in manifests.columns if c != "action_id"]
    index = queued.groupBy("action_id").agg(F.max_by(F.struct(*columns), F.coalesce("submitted_at", F.lit(""))).alias("x")).select("action_id", "x.*")
    place = target(root, "actions/queue_index")
    index.write.mode("overwrite").json(place)
    return spark.read.schema(index.schema).json(place)


def regenerate(tables: dict[str, tuple[DataFrame, list[str]]], root: str) -> None:
    """Writes each registry as text anew, with its columns in their order; columns that a registry hasn't are empty."""
    for name, (rows, columns) in tables.items():
        have = [F.col(c) if c in rows.columns else F.lit("").alias(c) for c in columns]
        write_tsv(rows.select(*have), target(root, f"layers/{name}"), columns)


def target(root: str, path: str, prefixes: tuple[str, ...] = WRITABLE) -> str:
    """The place of a relative path below root; raises where it may not be written."""
    if not allowed_target(path, prefixes):
        raise ValueError(f"not a place to write to: {path}")
    return f"{root.rstrip('/')}/{posixpath.normpath(path)}"


def allowed_target(path: str, prefixes: tuple[str, ...]) -> bool:
    """Whether a relative path stays below one of the prefixes, after its dots are resolved."""
    if path.startswith("/") or "\\" in path or "\0" in path:
        return False
    clean = posixpath.normpath(path)
    return not clean.startswith("..") and any(clean == p.rstrip("/") or clean.startswith(p.rstrip("/") + "/") for p in prefixes)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
