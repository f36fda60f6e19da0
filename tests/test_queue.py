"""A log kept by a stream, through restarts, replays and compaction."""

import json
from datetime import datetime, timedelta

from gridtally.streaming import queue
from gridtally.streaming.log import log_stream

KEY, ORDER = ["action_id"], ["at"]


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def entry(i, at, state):
    return {"action_id": f"a{i}", "at": at, "state": state}


def test_restarts_and_replays(spark, tmp_path):
    schema = spark.createDataFrame([], "action_id string, at long, state string").schema
    source, root, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    run = lambda: queue.append_once(log_stream(spark, str(source), schema), root, check).awaitTermination()
    table = lambda: {r.action_id: r.state for r in queue.index(spark, root, schema, KEY, ORDER).collect()}
    assert table() == {} and queue.compact(spark, root, schema, KEY, ORDER) is None
    put(source, "1.json", [entry(1, 1, "new"), entry(2, 1, "new"), entry(1, 2, "done")])
    run()
    put(source, "2.json", [entry(2, 5, "failed"), entry(3, 4, "new")])
    run()
    assert table() == {"a1": "done", "a2": "failed", "a3": "new"} and queue.log(spark, root, schema).count() == 5
    # a batch that was written, but whose end the checkpoint doesn't know, comes again
    last = max(int(p.name) for p in (tmp_path / "check" / "commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "check" / "commits").iterdir():
        if str(last) in p.name:
            p.unlink()
    run()
    assert queue.log(spark, root, schema).count() == 5 and table() == {"a1": "done", "a2": "failed", "a3": "new"}
    assert queue.compact(spark, root, schema, KEY, ORDER) == last and queue.compact(spark, root, schema, KEY, ORDER) is None
    put(source, "3.json", [entry(3, 9, "done"), entry(1, 1, "old")])
    run()
    assert table() == {"a1": "done", "a2": "failed", "a3": "done"}
    assert {r.batch_id for r in queue.log(spark, root, schema, after=last).collect()} == {last + 1}
    # what a broken writer left isn't read
    (tmp_path / "out" / "snapshot" / "upto=99").mkdir()
    assert table()["a3"] == "done"


def test_expiry(spark, tmp_path):
    schema = spark.createDataFrame([], "id string, at timestamp, v long").schema
    source, check, start = tmp_path / "in", str(tmp_path / "check"), datetime(2024, 1, 1)
    stamp = lambda s: (start + timedelta(seconds=s)).isoformat()
    seen = []

    def run():
        out = queue.latest_with_expiry(log_stream(spark, str(source), schema), "id", "at", "10 seconds", 60)
        keep = lambda batch, _: seen.extend((r.key, r.event, json.loads(r.entry)["v"]) for r in batch.collect())
        out.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()

    put(source, "1.json", [{"id": "x", "at": stamp(0), "v": 1}, {"id": "x", "at": stamp(5), "v": 2}, {"id": "y", "at": stamp(5), "v": 3}])
    run()
    put(source, "2.json", [{"id": "y", "at": stamp(50), "v": 4}, {"id": "x", "at": stamp(2), "v": 9}])
    run()
    assert sorted(seen) == [("x", "update", 2), ("y", "update", 3), ("y", "update", 4)]
    put(source, "3.json", [{"id": "z", "at": stamp(90), "v": 5}])
    run()
    put(source, "4.json", [{"id": "z", "at": stamp(95), "v": 6}])
    run()
    assert ("x", "expired", 2) in seen and ("y", "expired", 4) not in seen and ("z", "update", 6) in seen
