"""Parents recovered from planted families, and brute force over all triples."""

import itertools

import numpy as np

from gridtally.operators import pedigree, stats


def planted(sites=1500, seed=2):
    """Genotypes: a founder with 12 children by 12 mates, a couple with 5 children, a grandchild of each, and loose samples."""
    rng = np.random.default_rng(seed)
    freq = rng.uniform(0.2, 0.8, sites)
    found = lambda: rng.random((2, sites)) < freq
    pick = lambda g: g[rng.integers(2, size=sites), np.arange(sites)]
    two, parents = {i: found() for i in range(20)}, {}

    def child(a, b):
        k = len(two)
        two[k], parents[k] = np.stack([pick(two[a]), pick(two[b])]), (min(a, b), max(a, b))
        return k

    half = [child(0, m) for m in range(1, 13)]
    full = [child(13, 14) for _ in range(5)]
    child(half[0], full[0])
    child(half[1], 15)
    return {s: g.sum(axis=0).astype(int) for s, g in two.items()}, parents


def brute(genotypes, kin):
    """The best pair of parents of each sample over all triples."""
    theta = {(r.a, r.b): (r.king, r.ibs0 / r.n_sites) for r in kin}
    of = lambda x, y: theta[min(x, y), max(x, y)]
    close = lambda x, y: pedigree.FIRST[0] <= of(x, y)[0] <= pedigree.FIRST[1] and of(x, y)[1] <= 0.005
    best = {}
    for c in genotypes:
        for p, q in itertools.combinations([s for s in genotypes if s != c and close(c, s)], 2):
            if of(p, q)[0] < pedigree.RELATED:
                gc, gp, gq = genotypes[c], genotypes[p], genotypes[q]
                wrong = ((gc < (gp == 2).astype(int) + (gq == 2)) | (gc > (gp > 0).astype(int) + (gq > 0))).sum()
                if wrong <= 0.01 * len(gc):
                    best[c] = min(best.get(c, (9, 0, 0)), (wrong / len(gc), p, q))
    return {c: (p, q) for c, (_, p, q) in best.items()}


def test_planted_families(spark):
    genotypes, parents = planted()
    rows = [(s, i, int(x)) for s, g in genotypes.items() for i, x in enumerate(g)]
    dos = spark.createDataFrame(rows, "sample long, site long, dosage int")
    kin = stats.king(dos).cache()
    out = pedigree.pedigree(kin, dos).collect()
    got = {r.offspring: (r.parent1, r.parent2) for r in out}
    assert got == parents == brute(genotypes, kin.collect())
    assert all(r.n_errors == 0 and r.n_sites == 1500 for r in out) and {r.family for r in out} == {0}
    # of the 66 pairs of a founder's children only those are paired that kinship takes for unrelated
    assert pedigree.candidate_trios(kin).filter("offspring = 0").count() < 10


def test_nobody_related(spark):
    none = spark.createDataFrame([], "a long, b long, n_sites long, ibs0 long, king double")
    assert pedigree.pedigree(none, spark.createDataFrame([], "sample long, site long, dosage int")).count() == 0
