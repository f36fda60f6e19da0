"""Listings, formats, components, readiness, exact tests and clusters."""

import random
from math import comb

import pytest
from pyspark.sql import functions as F

from gridtally.operators import graph, rules, sampling, stats
from gridtally.sources import formats, listing


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_listing(spark, tmp_path):
    (tmp_path / "ld").mkdir()
    for name in ("x_LG28.tsv", "global.res", "odd.bin"):
        (tmp_path / name).write_text("1")
    (tmp_path / "ld" / "LG2.out").write_text("123")
    found = listing.files(spark, str(tmp_path))
    assert rows(found, "name", "bytes") == [("LG2.out", 3), ("global.res", 1), ("odd.bin", 1), ("x_LG28.tsv", 1)]
    types = [(r"\.tsv$", "table"), (r"^global\.", "kin"), ("^ld$", "ld")]
    known = found.filter("name = 'odd.bin'").select("path").limit(0)
    defaults = spark.createDataFrame([("table", "s1"), ("ld", "s1")], "type string, sample_set_id string")
    got = {r.path.rsplit("/", 1)[-1]: (r.type, r.chrom, r.problem) for r in listing.proposals(found, known, types, defaults).collect()}
    assert got == {"x_LG28.tsv": ("table", "C_gar_LG28", None), "global.res": ("kin", "global", "no sample set"), "odd.bin": (None, None, "unknown type"), "LG2.out": ("ld", "C_gar_LG2", None)}
    sites = spark.createDataFrame([("a", 5), ("a", 9), ("b", 1)], "chrom string, pos long")
    assert rows(listing.dosage_manifest(sites, spark.createDataFrame([("a", 3)], "chrom string, n_samples int"))) == [("a", 9, 3)]
    names = spark.createDataFrame([("k", "a_thin.gz"), ("k", "b.gz"), ("j", "exact.gz"), ("j", "a.gz")], "k string, path string")
    assert rows(listing.preferred(names, "k", F.col("path") == "exact.gz", "thin"), "k", "path") == [("j", "exact.gz"), ("k", "b.gz")]


def test_formats(spark):
    vcf = spark.createDataFrame([("##x",), ("#CHROM\tPOS",), ("c\t7\trs\tA\tC,G\t.\tPASS\tAF=0.5;DB\tGT\t0/1\t./.\t1|2",)], "line string")
    r = formats.vcf_sites(vcf).first()
    assert (r.chrom, r.pos, r.alts, r.info) == ("c", 7, ["C", "G"], {"AF": "0.5", "DB": "true"})
    assert rows(formats.vcf_dosages(vcf, ["a", "b", "d"]), "sample", "dosage") == [("a", 1), ("b", -1), ("d", 2)]
    bed = spark.createDataFrame([("track x",), ("c\t0\t10\tn",), ("c 5 6",)], "line string")
    assert rows(formats.bed_intervals(bed), "start", "end") == [(1, 10), (6, 6)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 140), rng.randrange(100, 140)) for _ in range(30)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert dict(rows(graph.components(spark.createDataFrame(edges, "a long, b long")))) == {x: find(x) for x in parent}


def test_chains(spark):
    results = spark.createDataFrame([("a", ""), ("b", "a"), ("c", "gone"), ("x", "y"), ("y", "x"), ("z", "x")], "result_id string, input_result_id string")
    assert rows(graph.upstream_problems(results)) == [("c", "missing"), ("x", "cycle"), ("y", "cycle"), ("z", "cycle")]


def test_fisher(spark):
    def exact(a, b, c, d):
        n, r, k = a + b + c + d, a + b, a + c
        p = {i: comb(k, i) * comb(n - k, r - i) / comb(n, r) for i in range(max(0, r + k - n), min(r, k) + 1)}
        return sum(v for v in p.values() if v <= p[a] * (1 + 1e-9))

    tables = [(8, 2, 1, 5), (3, 3, 3, 3), (0, 5, 5, 0), (10, 0, 0, 1)]
    out = stats.fisher_exact(spark.createDataFrame(tables, "a long, b long, c long, d long")).collect()
    assert all(abs(r.p - exact(r.a, r.b, r.c, r.d)) < 1e-9 for r in out)


def test_dbscan(spark):
    rng = random.Random(2)
    points = [("g", i, rng.gauss(cx, 0.2), rng.gauss(0, 0.2)) for i, cx in enumerate([0] * 30 + [5] * 30)] + [("g", 100, 50.0, 50.0), ("h", 200, 0.0, 0.0)]
    got = {r.id: r.cluster for r in stats.dbscan(spark.createDataFrame(points, "group_name string, id long, x double, y double"), 0.6, 4).collect()}
    near = {i: [j for g2, j, a, b in points if g2 == g and (a - x) ** 2 + (b - y) ** 2 <= 0.36] for g, i, x, y in points}
    core = {i for i in near if len(near[i]) >= 4}
    root = {i: i for i in core}
    for _ in range(60):
        root = {i: min(root[j] for j in near[i] if j in core) for i in core}
    expected = {i: root[i] if i in core else min((root[j] for j in near[i] if j in core), default=None) for i in near}
    assert got == expected and got[100] is None and got[200] is None


def test_flags(spark):
    p = spark.createDataFrame([("a", "homogeneous")] * 9 + [("a", "two_block")] + [("b", "two_block"), ("b", "homogeneous")], "k string, pattern string")
    assert dict(rows(rules.composite_flag(p, "k"))) == {"a": "clean", "b": "likely"}
    levels = spark.createDataFrame([("NONE",), ("SUPPORTED",), ("VALIDATED",), ("SUSPECT",)], "v string")
    assert [r[0] for r in levels.select(rules.version_gate(F.col("v"), "SUPPORTED")).collect()] == [False, True, True, False]


def test_chains_and_closures_have_no_bound_of_rounds(spark):
    n = 54
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "src long, dst long")
    assert rows(graph.chains(edges)) == [(0, n, n, list(range(n + 1)))]
    with pytest.raises(RuntimeError):
        graph.chains(edges, most=2)
    start = spark.createDataFrame([(0,)], "node long")
    assert rows(graph.closure(edges, start)) == [(0, i, i) for i in range(n + 1)]
    with pytest.raises(ValueError):
        graph.closure(spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"), spark.createDataFrame([(1,)], "node long"))


def test_components_of_a_long_path(spark):
    """500 nodes in a row and a ring, in rounds that are logarithmic."""
    edges = [(i, i + 1) for i in range(1, 500)] + [(1000 + i, 1000 + (i + 1) % 50) for i in range(50)]
    got = dict(rows(graph.components(spark.createDataFrame(edges, "a long, b long"), most=20)))
    assert got == {i: 1 for i in range(1, 501)} | {1000 + i: 1000 for i in range(50)}


def test_thinning_of_dense_and_far_sites(spark):
    rng = random.Random(3)
    data = [("c", rng.randrange(1, 20_000), i) for i in range(1500)] + [("c", 10_000_000 + 7 * i, 5000 + i) for i in range(100)] + [("d", 5, 1), ("d", 5, 2)]
    kept = []
    for c in "cd":
        last = None
        for p, i in sorted((p, i) for x, p, i in data if x == c):
            if last is None or p - last >= 37:
                kept.append((c, p, i))
                last = p
    df = spark.createDataFrame(data, "chrom string, pos long, site_id long")
    assert rows(sampling.thin_greedy(df, 37, width=500)) == kept
    assert sampling.thin_greedy(df, 0).count() == len(data)


def test_nearest_over_bins(spark):
    rng = random.Random(4)
    sites = [("c", rng.randrange(1, 5000) * 10, i) for i in range(200)] + [("e", 3, 900)]
    points = [("c", rng.randrange(1, 60_000), i) for i in range(300)] + [("d", 5, 400), ("e", 90_000, 401)]
    got = dict(rows(sampling.nearest(spark.createDataFrame(points, "chrom string, pos long, point_id long"), spark.createDataFrame(sites, "chrom string, pos long, site_id long"), width=700)))
    best = lambda c, p: min(((abs(q - p), q, i) for x, q, i in sites if x == c), default=(None, None, None))[2]
    assert got == {i: best(c, p) for c, p, i in points}


def test_tiers_by_pathway(spark):
    cases = {(1, 1, 1, 1, 1, 1, 2, 0): "1", (1, 1, 0, 1, 0, 1, 2, 0): "1", (1, 1, 0, 1, 1, 1, 2, 0): "4", (1, 1, 0, 1, 1, 1, 2, 4): "3", (1, 0, 1, 0, 1, 0, 0, 0): "2", (1, 1, 0, 0, 1, 1, 1, 0): "2", (0, 1, 0, 0, 1, 1, 2, 9): "SV-1", (0, 1, 0, 1, 1, 1, 1, 0): "SV-2", (0, 0, 1, 0, 1, 1, 0, 5): "3", (0, 0, 0, 1, 1, 1, 0, 9): "4"}
    names = ["a", "b", "c", "d", "c_tested", "d_tested"]
    df = spark.createDataFrame([(i, *map(bool, k[:6]), *k[6:]) for i, k in enumerate(cases)], f"i int, {', '.join(f'{n} boolean' for n in names)}, callers int, dimensions int")
    got = df.select("i", rules.confidence_tier(*map(F.col, names), F.col("callers"), F.col("dimensions")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == list(cases.values())


def test_keys_of_linkage_requests():
    from gridtally.functions.scalars import ld_key

    one = {"chrom": "c", "window_range": [1, 5], "groups": {"b": ["y", "x"], "a": ["z"]}, "shelf_bp": None, "snp_cap": 5000, "thin_to": None, "threads": 4}
    two = one | {"groups": {"a": ["z"], "b": ["x", "y"]}, "threads": 8, "triangle_assign": {"lower": "a"}}
    assert ld_key(one, "e") == ld_key(two, "e") != ld_key(one | {"snp_cap": 10}, "e") and len(ld_key(one, "e")) == len("fast_ld.split.") + 24


def test_shares_of_dropouts():
    assert abs(rules.dropout_share(4.5, 3) - 0.3423) < 1e-4


def test_long_chains_take_few_rounds(spark):
    n = 1000
    deep = [(str(i), "" if i == 0 else str(i - 1)) for i in range(n)]
    others = [("alone", ""), ("lost", "nowhere"), ("under_lost", "lost"), ("c1", "c2"), ("c2", "c1"), ("tail", "c1"), ("twig", "500"), ("self", "self")]
    results = spark.createDataFrame(deep + others, "result_id string, input_result_id string")
    assert rows(graph.chain_ends(results)) == sorted([("0", str(n - 1), n - 1), ("0", "twig", 501), ("alone", "alone", 0)])
    problems = {"lost": "missing", "under_lost": "missing", "c1": "cycle", "c2": "cycle", "tail": "cycle", "self": "cycle"}
    assert dict(rows(graph.upstream_problems(results))) == problems
    asked = spark.createDataFrame([("twig",), ("alone",), ("500",)], "leaf string")
    expected = [("alone", 0, "alone")] + [("twig", i, str(i)) for i in range(501)] + [("twig", 501, "twig")]
    assert rows(graph.chain_members(results, asked)) == sorted(expected)
    assert rows(graph.chain_ends(results.limit(0))) == [] and rows(graph.upstream_problems(results.limit(0))) == [] and rows(graph.chain_members(results.limit(0))) == []


def test_set_ids_are_streamed(spark):
    import hashlib

    from gridtally.operators import sets

    big = [f"m{i:05d}" for i in range(25_000)]
    data = [("big", m) for m in reversed(big)] + [("b", "x"), ("b", "x"), ("b", None), ("none", None), (None, "é"), (None, "z")]
    got = {r[0]: (r[1], r[2]) for r in sets.set_ids(spark.createDataFrame(data, "set_id string, member string")).collect()}
    of = lambda ms: "sha256:" + hashlib.sha256(("\n".join(ms) + "\n").encode()).hexdigest()
    assert got == {"big": (25_000, of(big)), "b": (1, of(["x"])), "none": (0, of([])), None: (2, of(["z", "é"]))}
