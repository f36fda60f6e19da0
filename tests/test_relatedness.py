"""Relatedness against a plain loop of expectation-maximisation."""

import numpy as np
import pytest

from gridtally.operators import relatedness

COLUMNS = "sample long, site long, g0 double, g1 double, g2 double"


def family(sites=600, seed=4):
    """Genotype likelihoods of founders, two children of the first two, and a copy of the first founder's genotypes."""
    rng = np.random.default_rng(seed)
    freq = rng.uniform(0.1, 0.9, sites)
    alleles = {s: rng.random((2, sites)) < freq for s in range(10)}
    pick = lambda s: alleles[s][rng.integers(2, size=sites), np.arange(sites)]
    alleles |= {10: np.stack([pick(0), pick(1)]), 11: np.stack([pick(0), pick(1)])}
    alleles[12] = alleles[0].copy()
    rows = []
    for s, two in alleles.items():
        for site, g in enumerate(two.sum(axis=0).tolist()):
            if rng.random() < 0.9:
                error = rng.uniform(0.01, 0.2)
                gl = [error / 2] * 3
                gl[g] = 1 - error
                rows.append((s, site, *gl))
    return rows, dict(enumerate(freq.tolist()))


def plain(rows, freq, a, b, rounds=60_000):
    """Loops over sites, genotypes and states, then plain rounds."""
    of = {(s, site): gl for s, site, *gl in rows}
    like = []
    for site, p in freq.items():
        if (a, site) in of and (b, site) in of:
            q = 1 - p
            single = [q * q, 2 * p * q, p * p]
            shared = {(0, 0): q**3, (0, 1): q * q * p, (1, 0): q * q * p, (1, 1): p * q, (1, 2): p * p * q, (2, 1): p * p * q, (2, 2): p**3}
            x = [0.0] * 3
            for i in range(3):
                for j in range(3):
                    g = of[a, site][i] * of[b, site][j]
                    x[0] += g * single[i] * single[j]
                    x[1] += g * shared.get((i, j), 0.0)
                    x[2] += g * single[i] * (i == j)
            like.append(x)
    like, w = np.array(like), np.full(3, 1 / 3)
    for _ in range(rounds):
        post = like * w
        w, old = (post / post.sum(axis=1)[:, None]).mean(axis=0), w
        if np.abs(w - old).max() < 1e-13:
            break
    return len(like), w


def test_fifty_pairs_as_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(relatedness, "BLOCK", 100)
    rows, freq = family()
    pairs = [(a, b) for a in range(13) for b in range(a + 1, 13)][:50] + [(0, 12), (10, 11), (1, 11), (0, 99)]
    gl, fr = spark.createDataFrame(rows + rows[:40], COLUMNS), spark.createDataFrame(list(freq.items()), "site long, freq double")
    asked = spark.createDataFrame(pairs, "a long, b long")
    got = {(r.a, r.b): r for r in relatedness.relatedness(gl, fr, asked).collect()}
    assert set(got) == set(pairs) and got[0, 99].n_sites == 0 and got[0, 99].theta is None
    for a, b in set(pairs) - {(0, 99)}:
        n, w = plain(rows, freq, a, b)
        r = got[a, b]
        assert r.n_sites == n and np.abs(w - [r.k0, r.k1, r.k2]).max() < 2e-4 and r.residual <= relatedness.TOLERANCE
        if w.min() > 1e-3:  # at the border a plain loop creeps
            assert np.abs(w - [r.k0, r.k1, r.k2]).max() < 1e-6
        assert abs(r.theta - w[1] / 4 - w[2] / 2) < 1e-4 and abs(r.rab - 2 * r.theta) < 1e-12
    assert got[0, 12].k2 > 0.95 and got[1, 11].k1 > 0.85 and 0.15 < got[10, 11].theta < 0.35 and got[2, 3].theta < 0.06
    monkeypatch.setattr(relatedness, "BROADCAST_PAIRS", 0)
    with pytest.raises(RuntimeError, match="settled"):
        relatedness.relatedness(gl, fr, asked.filter("a = 10"), rounds=1)


def test_frequencies(spark):
    gl = spark.createDataFrame([(1, 7, 1.0, 0.0, 0.0), (2, 7, 0.0, 0.0, 2.0), (3, 7, 0.0, 0.0, 0.0), (1, 8, 0.0, 0.0, 0.0)], COLUMNS)
    assert [tuple(r) for r in relatedness.allele_frequencies(gl).collect()] == [(7, 0.5)]


def test_short_pairs_stay_whole_among_many_sites(spark, monkeypatch):
    monkeypatch.setattr(relatedness, "BLOCK", 50)
    monkeypatch.setattr(relatedness, "PAIRS_A_TASK", 2)
    rows, freq = family()
    rows = [r for r in rows if r[0] < 3 or r[1] % 40 == 0]  # three samples of all sites, ten of a few
    pairs = [(0, 1), (1, 2), (3, 4), (4, 5), (0, 6), (10, 11), (12, 12)]
    gl, fr = spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(list(freq.items()), "site long, freq double")
    asked = spark.createDataFrame(pairs, "a long, b long")
    blocks = {}
    for r in relatedness._pair_blocks(gl, fr, asked).collect():
        blocks.setdefault((r.a, r.b), []).append(len(r.rows) // 3)
    assert set(blocks) == set(pairs) and all(len(blocks[p]) == 1 for p in pairs[2:]) and all(len(blocks[p]) > 4 for p in pairs[:2])
    got = {(r.a, r.b): r for r in relatedness.relatedness(gl, fr, asked).collect()}
    for a, b in pairs:
        n, w = plain(rows, freq, a, b)
        assert got[a, b].n_sites == n == sum(blocks[a, b]) and np.abs(w - [got[a, b].k0, got[a, b].k1, got[a, b].k2]).max() < 2e-4
    with pytest.raises(RuntimeError, match="settled"):
        relatedness.relatedness(gl, fr, asked.filter("a = 10"), rounds=1)
