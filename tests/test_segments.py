"""Stale segments: the dry run changes nothing, the run only what it must."""

from gridtally.sources import segments

SEGMENTS = [("A", "A_L", "seg", 0, 10), ("A", "A_R", "seg", 10, 20), ("A", "A_dco", "seg_dco", 12, 15), ("A", "A", "inv", 0, 99), ("B", "B_L", "seg", 0, 5), ("C:1", "C_L", "seg", 1, 7), ("D", "D_L", "seg", 3, 4)]
BREAKS = [("A", 0), ("A", 10), ("A", 20), ("B", 0), ("B", 5), ("C:1", 1)]


def files(folder):
    return {p.relative_to(folder).as_posix() for p in folder.rglob("*.parquet")}


def test_only_touched_partitions_change(spark, tmp_path):
    root = str(tmp_path)
    seg = spark.createDataFrame(SEGMENTS, "cid string, segment_id string, scale string, start long, end long")
    groups = spark.createDataFrame([(c, s, f"inv_{s}_{k}") for c, s, *_ in SEGMENTS for k in ("REF", "INV")], "cid string, segment_id string, group_id string")
    manifest = spark.createDataFrame([(c, s, i) for i, (c, s, *_) in enumerate(SEGMENTS) if c != "C:1"], "cid string, segment_id string, result_id long")
    for name, rows in (("segments", seg), ("groups", groups), ("manifest", manifest)):
        rows.coalesce(1).write.partitionBy("cid").parquet(f"{root}/{name}")
    breaks = spark.createDataFrame(BREAKS, "cid string, position long")
    before = files(tmp_path)
    want = {("A", 1, 2, 1), ("C:1", 1, 2, 0)}
    told = lambda df: {(r.cid, r.candidates, r.groups, r.manifest_rows) for r in df.collect()}
    assert told(segments.collect(spark, root, breaks, "t0")) == want and files(tmp_path) == before
    assert told(segments.collect(spark, root, breaks, "t1", dry_run=False)) == want
    after = files(tmp_path)
    still = {f for f in before if "cid=B" in f or "cid=D" in f}
    assert still <= after and not any("cid=C" in f for f in after)
    assert not (after & {f for f in before if "cid=A" in f})
    left = {r.segment_id for r in spark.read.parquet(f"{root}/segments").collect()}
    assert left == {"A_L", "A_R", "A", "B_L", "D_L"} == {r.segment_id for r in spark.read.parquet(f"{root}/groups").collect()}
    assert {r.segment_id for r in spark.read.parquet(f"{root}/_archive/t1/segments").collect()} == {"A_dco", "C_L"}
    # nothing is stale any more
    assert told(segments.collect(spark, root, breaks, "t2", dry_run=False)) == set() and files(tmp_path) == after
