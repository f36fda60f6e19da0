"""Whitening against a plain computation, on the given table and on odd rows."""

from fractions import Fraction

import numpy as np
import pytest

from gridtally.llm import whitening
from gridtally.llm.queries import op11_whitening

ODD = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (2, None), (3, []), (4, [1.0, None]), (5, [float("nan"), 0.0]), (6, [float("inf"), 0.0]), (7, [1.0, 2.0, 3.0]), (8, [-0.25, 0.75]), (None, [0.125, -3.0]), (9, [0.5, 1.0]), (10, [1e300, 1.0]), (11, [0.0, 0.0])]


def plain(vectors):
    """n, deviations, whitened values and shares by exact fractions and one eigh."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, d = len(fit), len(fit[0])
    sums = [sum(v[i] for v in fit) for i in range(d)]
    num = np.array([[n * v[i] - sums[i] for i in range(d)] for v in fit], object)
    cov = np.array([[float(Fraction(int((num[:, i] * num[:, j]).sum()), n**3)) for j in range(d)] for i in range(d)])
    values, parts = np.linalg.eigh(cov)
    order = np.argsort(-values)[:16]
    rows = np.array([[float(Fraction(n * v[i] - sums[i], n)) for i in range(d)] for v in x])
    return n, [sum((n * v[i] - sums[i]) ** 2 for i in range(d)) for v in x], rows @ parts[:, order] / np.sqrt(values[order]), values[order] / np.trace(cov)


def test_whitening_of_the_given_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, white, share = plain([r.embedding for r in rows])
    out = op11_whitening(spark, sf).toPandas().sort_values(["vec_id", "component"])
    assert len(out) == 16 * len(rows) and set(out.n) == {n}
    assert out.deviation.to_numpy().reshape(-1, 16)[:, 0].tolist() == deviation
    got = out.whitened.to_numpy().reshape(-1, 16)
    assert np.abs(got * np.sign((got * white).sum(axis=0)) - white).max() < 1e-7
    assert np.abs(out.explained.to_numpy().reshape(-1, 16)[0] - share).max() < 1e-12
    assert out.identity_error.max() < 1e-9 and out.identity_error.nunique() == 1


def test_odd_rows(spark):
    df = spark.createDataFrame([(i, v, "z", "z") for i, v in ODD], "vec_id long, embedding array<double>, x string, whitened string")
    out = whitening.components(df).toPandas()
    assert sorted(map(str, out.vec_id)) == sorted(str(float(i)) if i else "nan" for i in (1, 1, 8, None, 9, 11) for _ in range(2)) and set(out.n) == {4}
    kept = [v for i, v in ODD if i in (1, 8, None, 9, 11)]
    n, deviation, white, share = plain(kept)
    assert sorted(out.deviation) == sorted(d for d in deviation for _ in range(2))
    assert np.allclose(sorted(np.abs(out.whitened)), sorted(np.abs(white).ravel())) and out.identity_error.max() < 1e-9
    model = whitening.fit(df)
    assert model.transform(df).columns == [*df.columns, "deviation", "_whitened"]


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]] * 3, [[]], [None]])
def test_nothing_to_whiten(spark, vectors):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    assert whitening.components(df).count() == 0


def test_sums_beyond_64_bits():
    num = whitening.numerators(np.array([[2**52, 5], [3, 2**52]]), 1000, [10**15 + 7, 3])
    assert num[0][0] == 2**52 * 1000 - 10**15 - 7 and whitening.squares(num)[0] is None
    assert whitening.squares(whitening.numerators(np.array([[7, 5]]), 2, [13, 9])) == [2]
