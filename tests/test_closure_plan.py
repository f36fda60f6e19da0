"""Rounds of a closure don't broadcast what they join."""

from gridtally.operators import graph


def test_no_round_broadcasts(spark, monkeypatch):
    plans, real = [], graph.checkpointed

    def seen(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())  # as it ran, adapted
        return real(df)

    monkeypatch.setattr(graph, "checkpointed", seen)
    edges = spark.createDataFrame([(i, i // k) for i in range(1, 60) for k in (2, 3) if i // k], "src long, dst long")
    found = {(r.start, r.node): r.depth for r in graph.closure(edges, spark.createDataFrame([(59,), (8,)], "node long")).collect()}
    assert found[8, 1] == 3 and found[59, 1] == 5 and found[8, 8] == 0
    joined = [p for p in plans if "Join" in p]
    assert joined and not any("Broadcast" in p for p in joined)
