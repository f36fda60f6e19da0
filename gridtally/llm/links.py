"""Connected components over link tables."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtally.session import checkpointed


def forest(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, root) for each node of links (a, b) that isn't the smallest of its component.

    Large-star and small-star steps in turn: each hangs the neighbours of a node on the least
    of them, so the number of links never grows and a few rounds leave one star a component.
    Where rounds is set and reached before, it raises.
    """
    edges = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).filter("node <> root").distinct()
    edges = checkpointed(edges)
    for done in itertools.count():
        # stars, one a component: every node hangs on one root, and no root hangs on another
        roles = edges.select(F.col("node").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(edges.select("root", F.lit(0), F.lit(1)))
        held = roles.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
        if held.filter("hangs > 1 or (hangs = 1 and holds = 1)").isEmpty():
            return edges
        if done == rounds:
            raise RuntimeError(f"links are no stars after {rounds} rounds")
        both = edges.union(edges.select(F.col("root"), F.col("node")))
        least = both.groupBy("node").agg(F.min("root").alias("least")).select("node", F.least("least", "node").alias("least"))
        large = both.join(least, "node").filter("root > node and root <> least").select(F.col("root").alias("node"), F.col("least").alias("root"))
        # what lies below its own node stays hung on the least
        large = large.union(least.filter("node <> least").select("node", F.col("least").alias("root")))
        low = large.groupBy("node").agg(F.min("root").alias("least"))
        small = large.join(low, "node").filter("root <> least").select(F.col("root").alias("node"), F.col("least").alias("root"))
        edges = checkpointed(small.union(low.select("node", F.col("least").alias("root"))).distinct())
