"""Seeded classes against a plain loop; division over distances."""

import math
import random

import pytest

from gridtally.operators import clusters


def plain(xs, centres):
    while True:
        at = [min(range(len(centres)), key=lambda i: (abs(x - centres[i]), i)) for x in xs]
        new = [sum(v) / len(v) if (v := [x for x, a in zip(xs, at) if a == i]) else centres[i] for i in range(len(centres))]
        if all(abs(a - b) < 1e-11 for a, b in zip(new, centres)):
            rss = sum((x - centres[a]) ** 2 for x, a in zip(xs, at))
            n, k = len(xs), len(centres)
            return at, n * math.log(2 * math.pi * rss / n) + n - 2 * sum(m * math.log(m / n) for i in range(k) if (m := at.count(i))) + 2 * k * math.log(n)
        centres = new


def test_classes_as_a_plain_loop(spark):
    rng = random.Random(3)
    data = {g: [round(rng.gauss(m, 0.4), 6) for m in means for _ in range(60)] for g, means in {"three": (-2, 0, 2), "two": (-2, 2), "one": (0,)}.items()}
    points = [(g, i, x) for g, xs in data.items() for i, x in enumerate(xs)] + [("bare", i, float(i)) for i in range(5)] + [("three", 999, None)]
    seeds = []
    for g, xs in data.items():
        order = sorted(range(len(xs)), key=xs.__getitem__)
        mid = len(xs) // 2
        seeds += [(g, i, "HOM_REF") for i in order[:3]] + [(g, i, "HET") for i in order[mid : mid + 3]] + [(g, i, "HOM_INV") for i in order[-3:]]
    seeds += [("bare", 0, "HOM_REF"), ("bare", 1, "HET")]
    p, s = spark.createDataFrame(points, "group string, id long, x double"), spark.createDataFrame(seeds, "group string, id long, label string")
    want = {}
    for k in (2, 3):
        labelled, fits = clusters.seeded_classes(p, s, k)
        got = {(r.group, r.id): r.label for r in labelled.collect()}
        status = {r.group: r for r in fits.collect()}
        assert status["bare"].status == "no_seeding" and status["bare"].bic is None and not any(g == "bare" for g, _ in got)
        for g, xs in data.items():
            start = [sum(v) / len(v) for label in clusters.CLASSES[k] if (v := [xs[i] for h, i, at in seeds if h == g and at == label])]
            at, bic = plain(xs, start)
            assert [got[g, i] for i in range(len(xs))] == [clusters.CLASSES[k][a] for a in at]
            assert status[g].n == len(xs) and abs(status[g].bic - bic) < 1e-6
            want[g, k] = bic
    phased = spark.createDataFrame([("three", i, i % 2 == 0) for i in range(180)], "group string, id long, supported boolean")
    q = {r.group: r for r in clusters.class_quality(p, s, phased).collect()}
    assert abs(q["three"].bic_gap_k3_vs_k2 - (want["three", 2] - want["three", 3])) < 1e-6 and q["three"].bic_gap_k3_vs_k2 > 0 > q["two"].bic_gap_k3_vs_k2
    assert q["three"].n_het_phase_supported / q["three"].n_het == q["three"].het_phase_support_fraction and q["bare"].n_het is None


def test_moving_on_raises(spark):
    p = spark.createDataFrame([("g", i, float(i * i)) for i in range(50)], "group string, id long, x double")
    c = spark.createDataFrame([("g", [0.0, 1.0])], "group string, centres array<double>")
    with pytest.raises(RuntimeError, match="move"):
        clusters.lloyd(p, c, rounds=1)


def test_persistence(spark):
    rows = [("c", "a", "b", d, 0.9) for d in (1, 2, 5)] + [("c", "a", "x", 1, 0.95), ("c", "a", "x", 2, 0.5), ("c", "a", "x", 5, 0.9), ("c", "y", "z", 1, 0.9), ("c", "y", "z", 2, 0.9), ("d", "y", "z", 1, 0.81), ("e", "y", "z", 1, 0.8)]
    df = spark.createDataFrame(rows, "candidate string, a string, b string, distance int, concordance double")
    assert sorted(tuple(r) for r in clusters.persistent_carriers(df).collect()) == [("c", "a"), ("c", "b"), ("d", "y"), ("d", "z")]
    got = {r.candidate: tuple(r)[1:] for r in clusters.carrier_scores(df).collect()}
    assert got == {"c": (3, 1, 1, 0.5), "d": (1, 1, 0, 1.0), "e": (1, 0, 0, None)}


def test_points_are_made_once(spark):
    """Each round made the points again, with the joins that they come from."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    p = spark.createDataFrame([("g", i, float(i * i)) for i in range(50)], "group string, id long, x double").mapInPandas(counted, "group string, id long, x double")
    out = clusters.lloyd(p, spark.createDataFrame([("g", [0.0, 1.0])], "group string, centres array<double>")).collect()
    assert len(out) == 1 and made.value == 50
