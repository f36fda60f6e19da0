"""Set algebra over members, with ids that depend on the content alone."""

from __future__ import annotations

import hashlib
import itertools
import json
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def intersect_all(members: DataFrame, parents: list[str]) -> DataFrame:
    """Members (set_id, member) that all the parents have, by one aggregation."""
    return members.filter(F.col("set_id").isin(parents)).groupBy("member").agg(F.countDistinct("set_id").alias("n")).filter(F.col("n") == len(set(parents))).select("member")


def union_all(members: DataFrame, parents: list[str]) -> DataFrame:
    return members.filter(F.col("set_id").isin(parents)).select("member").distinct()


def difference(members: DataFrame, first: str, rest: list[str]) -> DataFrame:
    """Members of the first set that none of the others has."""
    inside = F.max((F.col("set_id") == first).cast("int"))
    outside = F.max(F.col("set_id").isin(rest).cast("int")) if rest else F.lit(0)
    return members.filter(F.col("set_id").isin([first, *rest])).groupBy("member").agg(inside.alias("i"), outside.alias("o")).filter("i = 1 and o = 0").select("member")


def members_digest(sorted_members: Column) -> Column:
    """sha256 of the members, one a line, behind 'sha256:'."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.array_join(sorted_members, "\n"), F.lit("\n")), 256))


def _digests(batches):
    """(set_id, n_members, members_hash) of rows that come by set and member; a set may go on from batch to batch."""
    current, digest, n = None, None, 0
    for batch in batches:
        done = []
        for key, run in itertools.groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), itemgetter(0)):
            if digest is None or key != current:
                if digest is not None:
                    done.append((current, n, digest))
                current, digest, n = key, hashlib.sha256(), 0
            names = [m for _, m in run if m is not None]
            n += len(names)
            digest.update("".join(m + "\n" for m in names).encode())
        yield _digest_rows(done, batch.schema.field(0).type)
        kind = batch.schema.field(0).type
    if digest is not None:
        yield _digest_rows([(current, n, digest)], kind)


def _digest_rows(done: list, kind) -> pa.RecordBatch:
    for _, n, digest in done:
        if not n:
            digest.update(b"\n")
    hashes = pa.array(["sha256:" + d.hexdigest() for _, _, d in done], pa.string())
    return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in done], kind), pa.array([n for _, n, _ in done], pa.int64()), hashes], ["set_id", "n_members", "members_hash"])


def set_ids(members: DataFrame) -> DataFrame:
    """(set_id, n_members, members_hash, sample_set_id); the id doesn't depend on order or repeats.

    The hash is over all members in order, so a set is read by one task, but as a stream of sorted rows: no set lies whole in memory.
    """
    kept = members.select("set_id", F.col("member").cast("string").alias("member")).distinct()
    in_order = kept.repartition("set_id").sortWithinPartitions("set_id", "member")
    hashed = in_order.mapInArrow(_digests, f"set_id {dict(kept.dtypes)['set_id']}, n_members long, members_hash string")
    return hashed.withColumn("sample_set_id", F.concat(F.lit("sset_"), F.substring("members_hash", len("sha256:") + 1, 16)))


def canonical_json(value) -> str:
    """Sorted keys, no blanks, non-ASCII as it is."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def params_hash(params: dict) -> str:
    return "sha256:" + hashlib.sha256(canonical_json(params).encode("utf-8")).hexdigest()


def result_ids(requests: DataFrame) -> DataFrame:
    """Adds result_id from analysis_id, sample_set_id, artifacts (an array, in any order, repeats counting once) and params_hash."""
    parts = F.concat_ws("|", "analysis_id", "sample_set_id", F.array_join(F.array_sort(F.array_distinct("artifacts")), ","), "params_hash")
    return requests.withColumn("result_id", F.concat(F.lit("res_"), F.substring(F.sha2(parts, 256), 1, 16)))


def plan(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests with state 'cached' where a stored result has their id, else 'todo'."""
    known = stored.select("result_id").distinct().withColumn("_known", F.lit(True))
    return result_ids(requests).join(known, "result_id", "left").withColumn("state", F.when(F.col("_known"), "cached").otherwise("todo")).drop("_known")


def combine_cohorts(a: DataFrame, b: DataFrame, same_genome: bool, composition_a: list[str], composition_b: list[str]) -> DataFrame:
    """The samples of two cohorts of one genome and one composition, each once."""
    if not same_genome or sorted(set(composition_a)) != sorted(set(composition_b)):
        raise ValueError("cohorts combine only within one genome and one composition")
    return a.unionByName(b).dropDuplicates(["sample_id"])


def pair_name(a: Column, b: Column) -> Column:
    """One name for a pair, whichever comes first."""
    return F.concat_ws("__vs__", F.least(a, b), F.greatest(a, b))


def csv_list(values: Column) -> Column:
    """Sorted, distinct, comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(values)), ",")


def csv_items(cell: Column) -> Column:
    """The items of a comma-joined cell, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
