"""The registered queries that SQL can't express, against plain loops over the same tables."""

import pandas as pd

from gridtally.queries import QUERIES
from tests.test_clusters import plain as plain_classes
from tests.test_relatedness import plain as plain_pair


def test_class_quality(spark, sf):
    o = pd.read_parquet(f"{sf}/orders.parquet").merge(pd.read_parquet(f"{sf}/customer.parquet"), left_on="o_custkey", right_on="c_custkey").sort_values("o_orderkey")
    o["x"] = o.o_totalprice.astype(float) / 1000
    got = {r.group: r for r in QUERIES["class_quality"](spark, sf).collect()}
    assert set(got) == set(o.o_orderpriority)
    for g, rows in o.groupby("o_orderpriority"):
        seeds = rows[rows.c_nationkey < 3]
        parts = {"HOM_REF": seeds[seeds.x < 150].x, "HET": seeds[(seeds.x >= 150) & (seeds.x < 300)].x, "HOM_INV": seeds[seeds.x >= 300].x}
        r = got[g]
        assert r.n == len(rows)
        if min(map(len, parts.values())) < 2:
            assert r.status == "no_seeding" and r.n_het is None
            continue
        at, three = plain_classes(rows.x.tolist(), [parts[k].mean() for k in ("HOM_REF", "HET", "HOM_INV")])
        _, two = plain_classes(rows.x.tolist(), [parts[k].mean() for k in ("HOM_REF", "HOM_INV")])
        held = sum(a == 1 and s == "F" for a, s in zip(at, rows.o_orderstatus))
        assert abs(r.bic_gap_k3_vs_k2 - (two - three)) < 0.01 and (r.n_het, r.n_het_phase_supported) == (at.count(1), held)


def test_relatedness_of_pairs(spark):
    sf = "/root/testdata/sf0.01"
    line = pd.read_parquet(f"{sf}/lineitem.parquet")
    calls = line.groupby(["l_suppkey", "l_partkey"]).size().sub(1).clip(upper=2).reset_index(name="x")
    gl = {(s, p): [0.98 if x == g else 0.01 for g in range(3)] for s, p, x in calls.itertuples(index=False)}
    freq = {}
    for p, rows in calls.groupby("l_partkey"):
        freq[p] = round(float(sum((gl[s, p][1] + 2 * gl[s, p][2]) / sum(gl[s, p]) for s in rows.l_suppkey)) / len(rows) / 2, 12)
    sup = pd.read_parquet(f"{sf}/supplier.parquet").sort_values("s_suppkey")
    pairs = [(a, b) for _, n in sup.groupby("s_nationkey") for a, b in zip(n.s_suppkey, n.s_suppkey[1:])]
    got = {(r.a, r.b): r for r in QUERIES["relatedness_of_pairs"](spark, sf).collect()}
    assert set(got) == set(pairs)
    flat = [(s, p, *v) for (s, p), v in gl.items()]
    for a, b in pairs[:6]:
        n, w = plain_pair([r for r in flat if r[0] in (a, b)], freq, a, b, rounds=20_000)
        assert got[a, b].n_sites == n and abs(got[a, b].theta - w[1] / 4 - w[2] / 2) < 1e-3
