"""Nearest neighbours against brute force, on the given table, on groups of copies and on odd rows."""

import numpy as np
import pytest

from gridtally.llm import neighbours
from gridtally.llm.queries import op12_nearest

SCHEMA = "vec_id long, embedding array<double>, score string, rank string, vector string"


def brute(rows, every, most=5):
    """{query id: [(id, score)]} over (id, vector) rows that are distinct and usable."""
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], float)
    length = np.sqrt((v * v).sum(axis=1))
    out = {}
    for k in np.flatnonzero(ids % every == 0):
        s = (v * v[k]).sum(axis=1) / (length * length[k])
        order = [j for j in np.lexsort((ids, -s)) if j != k][:most]
        out[int(ids[k])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_on_the_given_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = brute(rows, 50), answers(op12_nearest(spark, sf))
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    scores = {(q, i): s for q in want for i, s in want[q]}
    assert all(scores.get((q, i), s) == s for q in got for i, s in got[q])


def test_recall_with_cells_and_parts(spark, monkeypatch):
    """Clusters, many cells, small parts and several shares of queries: the same neighbours."""
    monkeypatch.setattr(neighbours, "PART", 50)
    monkeypatch.setattr(neighbours, "ASKED", 40)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 32))
    v = centres[rng.integers(30, size=3000)] + rng.normal(scale=0.4, size=(3000, 32))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    want = brute(rows, 20)
    got = answers(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)


def test_copies_ties_and_odd_rows(spark):
    base = [[1.0, 0.0, 0.5], [0.0, 1.0, 0.25], [-1.0, 0.0, 0.0], [1.0, 1.0, 1.0]]
    rows = [(i, base[0] if i % 3 else base[1 + i % 7 % 3]) for i in range(200)]
    rows += [(300, [2.0, 0.0, 1.0]), (400, [1e200, 0.0, 5e199]), (500, [-0.0, 1.0, 0.25])]
    odd = [(1000, None), (1001, []), (1002, [1.0, None, 2.0]), (1003, [float("nan")] * 3), (1004, [float("inf"), 0.0, 0.0]), (1005, [0.0] * 3), (1006, [1.0, 2.0]), (None, base[0]), (100, rows[100][1])]
    df = spark.createDataFrame([(i, v, "z", "z", "z") for i, v in rows + odd], SCHEMA)
    # an overflowing square is the brute force's own trouble: scaled by a power of two a cosine is the same
    plain = [(i, np.ldexp(v, -600).tolist() if i == 400 else v) for i, v in rows]
    want, got = brute(plain, 50), answers(neighbours.nearest(df, every=50))
    assert got.keys() == want.keys() and {i: [x for x, _ in v] for i, v in got.items()} == {i: [x for x, _ in v] for i, v in want.items()}
    assert all(a[1] == b[1] for q in want for a, b in zip(got[q], want[q]))


def test_an_id_with_two_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 1.0]), (1, [1.0, 0.1])], "vec_id long, embedding array<float>")
    out = sorted((r.vec_id, r["rank"]) for r in neighbours.nearest(df, every=50).collect())
    assert out == [(0, 2), (0, 2), (1, 1), (1, 1)]


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]]])
def test_no_candidates(spark, vectors):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    assert neighbours.nearest(df, every=50).count() == 0


def test_quantiles():
    assert abs(neighbours.chi_square_quantile(0.95, 16) - 26.29622760486423) < 1e-9
    assert abs(neighbours.chi_square_quantile(0.99, 2) - 9.210340371976182) < 1e-9


def test_the_tree_holds_every_point_once():
    points = np.random.default_rng(0).normal(size=(1000, 4)).round(1)
    tree = neighbours.Tree.of(points, 16)
    assert sorted(tree.order) == list(range(1000)) and tree.cuts[-1] == 1000
    for i, (a, b) in enumerate(zip(tree.cuts, tree.cuts[1:])):
        assert (points[tree.order[a:b]] >= tree.low[i]).all() and (points[tree.order[a:b]] <= tree.high[i]).all()
    cuts = neighbours.planes(points, 4)
    low, high = neighbours.boxes(cuts, 4)
    at = neighbours.cells(points, cuts)
    assert (points >= low[at]).all() and (points <= high[at]).all() and set(at) == set(range(16))
