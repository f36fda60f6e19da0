"""Operator 12: nearest neighbours by cosine, through stable projections and kd-trees.

A vector brought to length 1 is projected on DIMS Gaussian directions. For two vectors at distance r the squared
distance of their projections is r^2 times a chi-square variable of DIMS degrees of freedom, so once every candidate
within sqrt(q) * r of a query's projection is verified, q being that distribution's quantile for CONFIDENCE and r the
distance of the worst neighbour held, a nearer one has been missed with a chance of at most 1 - CONFIDENCE. Candidates
are met leaf by leaf in the order of their projected distance, and the search ends when that stopping test holds.

Equal vectors are searched once: a group of copies is one candidate with its least ids (one more than the neighbours
asked for, since a query leaves itself out), pre-limited before the shuffle, and one query. Projections are cut by
a kd-tree of CELLS cells, whose planes come from about SAMPLE projections (twice as many at most); every vector is indexed. A cell of more
than PART candidates is cut into parts, and a part met by more than ASKED queries is searched in so many
tasks, so a task's memory doesn't grow with the data. First a query is searched in its own cell, which bounds r; then in all
cells within sqrt(q) * r, with that bound.

Scores are computed in double precision from the vectors as they stand, entry by entry in one order, so they
don't depend on how rows lie in tasks. Recall against brute force is measured in the tests.

Defined cases: null, empty or zero vectors, vectors with a null, NaN or infinite entry, vectors whose length isn't the commonest,
and rows without an id take no part. Ties go to the smaller id. Rows that repeat an id and its vector count once; where an id has several
vectors, each is a query of its own and a candidate of the others. A query without candidates has no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtally.llm.vectors import common_size, finite
from gridtally.session import checkpointed

DIMS, CONFIDENCE, SEED = 16, 0.98, 12
CELLS, SAMPLE = 32, 16384
PART, ASKED, LEAF = 32768, 8192, 512
#: Distances are compared with this much of slack, for rounding.
SLACK = 1e-12


def chi_square_quantile(p: float, dims: int) -> float:
    """Where the chi-square distribution of an even number of degrees of freedom reaches p."""
    cdf = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
    low, high = 0.0, 4.0 * dims
    while cdf(high) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def matrix(column: pd.Series) -> np.ndarray:
    """Rows as doubles. Scaled by powers of two, which leaves a cosine as it is, where squares would overflow or vanish."""
    v = np.stack(column.to_numpy()).astype(float)
    power = np.frexp(np.abs(v).max(axis=1))[1]
    far = np.abs(power) > 400
    v[far] = np.ldexp(v[far], -power[far, None])
    return v


def lengths(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=1))


def cosines(v: np.ndarray, length: np.ndarray, q: np.ndarray, q_length: float) -> np.ndarray:
    return (v * q).sum(axis=1) / (length * q_length)


@dataclass
class Tree:
    """A kd-tree over points: the points of leaf i are order[cuts[i]:cuts[i + 1]] and lie between low[i] and high[i]."""

    order: np.ndarray
    cuts: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(points: np.ndarray, leaf: int) -> Tree:
        leaves, open_ = [], [np.arange(len(points))]
        while open_:
            at = open_.pop()
            spread = points[at].max(axis=0) - points[at].min(axis=0)
            if len(at) <= leaf or not spread.any():
                leaves.append(at)
                continue
            half = np.argpartition(points[at, spread.argmax()], len(at) // 2)
            open_ += [at[half[: len(at) // 2]], at[half[len(at) // 2 :]]]
        low, high = (np.array([f(points[at], axis=0) for at in leaves]) for f in (np.min, np.max))
        return Tree(np.concatenate(leaves), np.cumsum([0, *map(len, leaves)]), low, high)

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distances of a point to the leaves' boxes."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return (gap * gap).sum(axis=1)


def searched(candidates: pd.DataFrame, queries: pd.DataFrame, keep: int, quantile: float) -> pd.DataFrame:
    """The `keep` best (score, id) of each query among the candidates of one part."""
    found: list[tuple] = []
    if len(candidates) and len(queries):
        # ties go to the smaller id: candidates in the order of their least one
        candidates = candidates.assign(_least=[i[0] for i in candidates["ids"]]).sort_values("_least")
        v, ids, keys = matrix(candidates["vector"]), candidates["ids"].tolist(), candidates["key"].to_numpy()
        length, tree = lengths(v), Tree.of(points := np.stack(candidates["point"].to_numpy()), LEAF)
        v, length, points, keys = v[tree.order], length[tree.order], points[tree.order], keys[tree.order]
        for q, q_vector, point, bound in zip(queries["asked"], matrix(queries["vector"]), np.stack(queries["point"].to_numpy()), queries["bound"]):
            found += [(q, *x) for x in _best(tree, v, length, points, keys == q, ids, q_vector, point, bound, keep, quantile)]
    return pd.DataFrame(found, columns=["asked", "score", "vec_id", "own"])


def _best(tree, v, length, points, own, ids, q_vector, point, bound, keep, quantile):
    q_length = float(np.sqrt((q_vector * q_vector).sum()))
    radius = quantile * (bound + SLACK)
    held: list[tuple[float, int, bool]] = []  # (-score, id, of the query's own vector), ascending
    away = tree.distances(point)
    for leaf in np.argsort(away, kind="stable"):
        if away[leaf] > radius:  # the stopping test: all that is left lies farther
            break
        a, b = tree.cuts[leaf], tree.cuts[leaf + 1]
        gap = points[a:b] - point
        near = a + np.flatnonzero((gap * gap).sum(axis=1) <= radius)
        scores = cosines(v[near], length[near], q_vector, q_length)
        if len(held) == keep:
            good = scores >= -held[-1][0]
            near, scores = near[good], scores[good]
        if len(near):
            held += [(-s, i, o) for at, s, o in zip(tree.order[near].tolist(), scores.tolist(), own[near].tolist()) for i in ids[at]]
            held = sorted(held)[:keep]
            if len(held) == keep:
                radius = min(radius, quantile * (max(0.0, 2 + 2 * held[-1][0]) + SLACK))
    return [(-s, i, o) for s, i, o in held]


def planes(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """The cutting planes (dimension, value) of a kd-tree in the order of a heap: node i has the children 2i + 1 and 2i + 2."""
    out, level = [], [points]
    for _ in range(depth):
        halves = []
        for p in level:
            dim = int(np.ptp(p, axis=0).argmax()) if len(p) else 0
            value = float(np.median(p[:, dim])) if len(p) else 0.0
            out.append((dim, value))
            halves += [p[p[:, dim] < value], p[p[:, dim] >= value]]
        level = halves
    return out


def cells(points: np.ndarray, cuts: list[tuple[int, float]]) -> np.ndarray:
    """The cell of each point."""
    at = np.zeros(len(points), np.int64)
    dims, values = np.array([d for d, _ in cuts] or [0]), np.array([x for _, x in cuts] or [0.0])
    for _ in range((len(cuts) + 1).bit_length() - 1):
        at = 2 * at + 1 + (points[np.arange(len(points)), dims[at]] >= values[at])
    return at - len(cuts)


def boxes(cuts: list[tuple[int, float]], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper corners of all cells."""
    level = [(np.full(dims, -np.inf), np.full(dims, np.inf))]
    for i, (dim, value) in enumerate(cuts):
        low, high = level[i]
        below, above = high.copy(), low.copy()
        below[dim], above[dim] = value, value
        level += [(low, below), (above, high)]
    corners = level[len(cuts) :]
    return np.array([a for a, _ in corners]), np.array([b for _, b in corners])


def usable(rows: DataFrame, column: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part, each pair once."""
    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    v = v.filter(F.col("vec_id").isNotNull() & finite("vector") & F.exists("vector", lambda c: c != 0))
    d = common_size(v, "vector")
    # -0.0 and 0.0 are one value
    return v.filter(F.size("vector") == d).withColumn("vector", F.transform("vector", lambda c: c + 0.0)).distinct()


def _projected(groups: DataFrame) -> DataFrame:
    """groups with `point`, the projection of its vector."""

    def task(batches):
        for batch in batches:
            if len(batch):
                v = matrix(batch["vector"])
                directions = np.random.default_rng(SEED).normal(size=(v.shape[1], DIMS))
                yield batch.assign(point=list(v / lengths(v)[:, None] @ directions))

    return groups.mapInPandas(task, "key long, vector array<double>, ids array<bigint>, asks boolean, point array<double>")


def _celled(rows: DataFrame, cuts: list[tuple[int, float]]) -> DataFrame:
    def task(batches):
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=cells(np.stack(batch["point"].to_numpy()), cuts))

    return rows.mapInPandas(task, T.StructType([*rows.schema.fields, T.StructField("cell", T.LongType())]))


def _top(rows: DataFrame, key: str, keep: int, *order) -> DataFrame:
    """The first rows of each key; Spark limits them before the shuffle too."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("place") <= keep)


def _pairs(queries: DataFrame, parts: Column, shares: int, wanted: Column) -> DataFrame:
    """A row for each cell that a query wants and each part of it."""
    each = queries.withColumn("cell", F.explode(wanted))
    share = F.pmod(F.xxhash64("asked"), F.lit(shares)).alias("share")
    return each.select("asked", "vector", "point", "bound", "cell", F.explode(F.sequence(F.lit(0), F.get(parts, F.col("cell").cast("int")) - 1)).alias("part"), share)


def _search(candidates: DataFrame, pairs: DataFrame, keep: int, quantile: float) -> DataFrame:
    keys = ["cell", "part", "share"]
    grouped = candidates.groupBy(*keys).cogroup(pairs.groupBy(*keys))
    found = grouped.applyInPandas(lambda a, b: searched(a, b, keep, quantile), "asked long, score double, vec_id long, own boolean")
    return _top(found, "asked", keep, F.desc("score"), "vec_id").drop("place")


def nearest(rows: DataFrame, every: int, most: int = 5, column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the `most` nearest rows of each row whose vec_id is divisible by `every`."""
    keep, quantile = most + 1, chi_square_quantile(CONFIDENCE, DIMS)
    v = checkpointed(usable(rows, column))
    asks = F.col("vec_id") % every == 0
    few = _top(v, "vector", keep, "vec_id").groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    queries = v.filter(asks)
    asked = queries.select("vector").distinct().withColumn("asks", F.lit(True))
    groups = few.join(asked, "vector", "left").select(F.monotonically_increasing_id().alias("key"), "vector", "ids", F.coalesce("asks", F.lit(False)).alias("asks"))
    groups = checkpointed(_projected(groups))

    # drawn by a hash, so that tasks send about SAMPLE points together, however many tasks there are
    drawn = F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, groups.count())) * (1 << 30))
    sample = groups.filter(drawn).limit(2 * SAMPLE).select("point").toPandas()
    cuts = planes(np.stack(sample["point"].to_numpy()), CELLS.bit_length() - 1) if len(sample) else []
    celled = checkpointed(_celled(groups, cuts))
    sizes = {r.cell: r.n for r in celled.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    parts = F.array(*[F.lit(-(-sizes.get(c, 1) // PART)) for c in range(len(cuts) + 1)])
    first = celled.filter("asks").select(F.col("key").alias("asked"), "vector", "point", "cell")
    shares = max(1, -(-first.count() // ASKED))

    part = F.pmod(F.xxhash64("key"), F.get(parts, F.col("cell").cast("int"))).cast("int")
    indexed = celled.select("key", "vector", "ids", "point", "cell", part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<bigint>")).alias("share"))
    start = first.withColumn("bound", F.lit(float("inf")))
    near = checkpointed(_search(indexed, _pairs(start, parts, shares, F.array("cell")), keep, quantile))

    held = near.groupBy("asked").agg(F.when(F.count("*") >= keep, F.greatest(F.lit(0.0), 2 - 2 * F.min("score"))).otherwise(float("inf")).alias("bound"))
    rest = _with_cells(first.join(held, "asked"), cuts, quantile)
    more = _search(indexed, _pairs(rest, parts, shares, F.col("cells")), keep, quantile)
    best = _top(near.union(more), "asked", keep, F.desc("score"), "vec_id").groupBy("asked").agg(F.collect_list(F.struct("score", "vec_id", "own")).alias("found"))

    lists = best.join(first.select("asked", "vector"), "asked").select("vector", "found")
    each = queries.join(lists, "vector").select(F.col("vec_id").alias("query_id"), "vector", F.explode("found").alias("f")).filter("not (f.own and f.vec_id = query_id)")
    place = F.row_number().over(Window.partitionBy("query_id", "vector").orderBy(F.desc("f.score"), "f.vec_id"))
    return each.withColumn("rank", place).filter(F.col("rank") <= most).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))


def _with_cells(queries: DataFrame, cuts: list[tuple[int, float]], quantile: float) -> DataFrame:
    """queries with `cells`: those besides their own that the stopping test doesn't rule out."""

    def task(batches):
        low, high = boxes(cuts, DIMS)
        for batch in batches:
            out = []
            for point, cell, bound in zip(batch["point"], batch["cell"], batch["bound"]):
                gap = np.maximum(np.maximum(low - point, point - high), 0)
                wanted = np.flatnonzero((gap * gap).sum(axis=1) <= quantile * (bound + SLACK))
                out.append(wanted[wanted != cell])
            yield batch.drop(columns="cell").assign(cells=out)

    kept = queries.select("asked", "vector", "point", "bound", "cell")
    return kept.mapInPandas(task, "asked long, vector array<double>, point array<double>, bound double, cells array<bigint>")
