"""Kinship of all pairs against a plain loop; what is shuffled are calls, not pairs."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridtally.operators import stats
from gridtally.projections import dosages

FIELDS = ["n_sites", "ibs0", "ibs1", "ibs2"]


def _plain(calls):
    sites, found = defaultdict(list), defaultdict(Counter)
    for sample, site, x in calls:
        if None not in (sample, site) and x >= 0:
            sites[site].append((sample, x))
    for at in sites.values():
        for a, x in at:
            for b, y in at:
                if a < b:
                    found[a, b].update({"n_sites": 1, f"ibs{2 - abs(x - y)}": 1, "both": x == y == 1, "hets": (x == 1) + (y == 1)})
    return {k: (*(c[f] for f in FIELDS), (c["both"] - 2 * c["ibs0"]) / c["hets"] if c["hets"] else None) for k, c in found.items()}


def _found(df):
    rows = df.collect()
    got = {(r.a, r.b): (*(r[f] for f in FIELDS), r.king) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("kind", ["long", "string"])
def test_all_pairs_in_blocks_and_parts(spark, monkeypatch, kind):
    rng = random.Random(6)
    name = (lambda s: s * 7 - 50) if kind == "long" else (lambda s: f"s{s}é")
    calls = [(name(s), site, rng.randrange(-1, 3)) for s in range(40) for site in range(30) if s == 3 or rng.random() < 0.3]
    calls += calls[:40]  # a call that stands twice counts twice
    calls += [(None, 1, 1), (name(1), None, 1), (name(60), 77, 2)]  # no sample, no site, alone at its site
    df = spark.createDataFrame(calls, f"sample {kind}, site long, dosage int")
    want = _plain(calls)
    assert len(want) > 500 and _found(stats.king(df)) == want
    monkeypatch.setattr(stats, "PAIRS_PER_TASK", 60)  # many blocks, and sample 3 alone in several parts
    many = stats.king(df)
    assert _found(many) == want
    monkeypatch.setattr(stats, "BROADCAST_SAMPLES", 0)
    assert _found(stats.king(df)) == want
    above = many._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression [a#")[0]
    assert above.count("Generate explode") == 2 and "Join" not in above  # pairs are made behind the shuffle
    assert stats.king(df.filter("site < 0")).count() == 0


def test_dosages_by_site_are_the_same_calls(spark, sf):
    rows = lambda df: Counter(map(tuple, df.collect()))
    by_site = dosages(spark, sf, by_site=True)
    assert rows(by_site) == rows(dosages(spark, sf))
    plan = by_site.groupBy("site").agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
