"""Operators against brute force and small goldens."""

import random

import pytest
from pyspark.sql import functions as F

from gridtally.functions import scalars
from gridtally.operators import graph, intervals, registry, rules, sampling, sets, stats
from gridtally.plans.catalog import Catalog
from gridtally.plans.requests import ChunkRequest, GroupRequest, Region
from gridtally.plans.set_expr import SetExpr, members


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_windows_of_known_heterozygosity(spark):
    """F of 0, 1 and -1 at p = 0.5 gives ratios of 1, 0 and 2."""
    for f, ratio in ((0.0, 1.0), (1.0, 0.0), (-1.0, 2.0)):
        sites = spark.createDataFrame([("c", 1000 * i + 1, 0.5, f) for i in range(100)], "chrom string, pos long, hwe_freq double, f double")
        out = intervals.windowed_heterozygosity(intervals.heterozygosity(sites), spark.createDataFrame([("c", 100_000)], "chrom string, chrom_size long"), [("x", 10_000, 10_000)])
        assert [(r.n_sites, r.hover_e) for r in out.orderBy("win_idx").collect()] == [(10, ratio)] * 10


def test_no_sites_no_windows(spark):
    sites = spark.createDataFrame([], "chrom string, pos long, hobs double, hexp double")
    chroms = spark.createDataFrame([("c", 100)], "chrom string, chrom_size long")
    assert intervals.windowed_heterozygosity(sites, chroms, [("x", 10, 5)]).count() == 0


def test_too_many_windows_per_site(spark):
    with pytest.raises(ValueError):
        intervals.site_windows(spark.range(1).withColumn("pos", F.lit(1)), 1000, 1)


def test_merge_within_a_longer_interval(spark):
    df = spark.createDataFrame([("c", 1, 100, 1), ("c", 5, 10, 2), ("c", 120, 130, 3), ("c", 200, 210, 4), ("d", 1, 2, 5)], "chrom string, start long, end long, interval_id long")
    assert rows(intervals.merge_intervals(df, 20), "chrom", "start", "end", "members") == [("c", 1, 130, 3), ("c", 200, 210, 1), ("d", 1, 2, 1)]


def test_even_sample_against_brute_force(spark):
    rng = random.Random(3)
    data = [(c, rng.randrange(1, 3000), i) for c in "ab" for i in range(120)] + [("few", 5, 1), ("few", 9, 2)]
    got = rows(sampling.even_sample(spark.createDataFrame(data, "chrom string, pos long, site_id long"), 40), "chrom", "idx")
    expected = [("few", 0), ("few", 1)]
    for c in "ab":
        pos = sorted((p, i) for x, p, i in data if x == c)
        lo, hi, picks = pos[0][0], pos[-1][0], []
        for t in range(40):
            at = lo + (hi - lo) * (2 * t + 1) / 80
            below = [k for k, (p, _) in enumerate(pos) if p <= at]
            above = [k for k, (p, _) in enumerate(pos) if p > at]
            k = below[-1] if below and (not above or at - pos[below[-1]][0] <= pos[above[0]][0] - at) else above[0]
            if picks and picks[-1] == k:
                k = min(k + 1, len(pos) - 1)
            picks.append(k)
        expected += [(c, k) for k in dict.fromkeys(picks)]
    assert got == sorted(expected)


def test_greedy_thinning_against_brute_force(spark):
    rng = random.Random(4)
    data = [("c", rng.randrange(1, 20_000), i) for i in range(300)]
    kept, last = [], None
    for c, p, i in sorted(data, key=lambda x: (x[1], x[2])):
        if last is None or p - last >= 150:
            kept.append((c, p, i))
            last = p
    assert rows(sampling.thin_greedy(spark.createDataFrame(data, "chrom string, pos long, site_id long"), 150)) == sorted(kept)


def test_thin_to(spark):
    df = spark.createDataFrame([("c", i, i) for i in range(100)], "chrom string, pos long, site_id long")
    assert sampling.thin_to(df, 10).count() == 10 and sampling.thin_to(df, 200).count() == 100


def test_layer_states(spark):
    """All states, with a chain, an unknown input, a ready input, and a cycle."""
    kinds = {"here": ("file", True, None, False), "away": ("file", False, None, False), "odd": ("table", True, "active", True), "done": (None, None, "active", True), "bad": (None, None, "failed", True), "no": (None, None, None, False)}
    free = ["free", "after", "next", "then", "lost", "x", "y", "under", "beside", "off"]
    data = [(n, k or "analysis_result", p, r, m) for n, (k, p, r, m) in kinds.items()] + [(n, "analysis_result", None, None, True) for n in free]
    layers = spark.createDataFrame(data, "layer string, source_kind string, present boolean, result string, has_producer boolean")
    edges = [("after", "done"), ("after", "here"), ("next", "after"), ("then", "next"), ("lost", "nowhere"), ("x", "y"), ("y", "x"), ("under", "bad"), ("beside", "away"), ("off", "odd")]
    needs = spark.createDataFrame(edges, "layer string, input string")

    def state(layer, seen=()):
        """One layer after the other, by the rules' own words."""
        if layer in seen:
            return "BLOCKED_BY_INPUT"
        row = next((r for r in data if r[0] == layer), None)
        if row is None or row[1] not in ("file", "analysis_result"):
            return "UNKNOWN_CONTRACT"
        if row[1] == "file":
            return "RESOLVED" if row[2] else "KNOWN_MISSING"
        if not row[4]:
            return "UNKNOWN_CONTRACT"
        if row[3]:
            return {"active": "COMPLETE", "failed": "FAILED"}[row[3]]
        above = [state(i, (*seen, layer)) for n, i in edges if n == layer]
        if all(a in ("RESOLVED", "COMPLETE") for a in above):
            return "READY_TO_RUN"
        return "BLOCKED_BY_INPUT" if any(a != "READY_TO_RUN" and a not in ("RESOLVED", "COMPLETE") for a in above) else "KNOWN_MISSING"

    assert dict(rows(graph.layer_states(layers, needs))) == {r[0]: state(r[0]) for r in data}


def test_roll_up(spark):
    parents = spark.createDataFrame([(p,) for p in ("none", "ok", "run", "bad", "out", "mix")], "parent string")
    states = spark.createDataFrame([("ok", "RESOLVED"), ("ok", "COMPLETE"), ("run", "READY_TO_RUN"), ("bad", "FAILED"), ("bad", "BLOCKED_BY_INPUT"), ("out", "KNOWN_MISSING"), ("out", "UNKNOWN_CONTRACT"), ("mix", "RESOLVED"), ("mix", "KNOWN_MISSING")], "parent string, state string")
    assert dict(rows(graph.roll_up(parents, states))) == {"none": "HIDDEN", "ok": "COMPLETE", "run": "READY_TO_RUN", "bad": "FAILED", "out": "BLOCKED", "mix": "PARTIAL"}


def test_edges(spark):
    """Ends, rules, and each of the constraints met and not met."""
    nodes = spark.createDataFrame([("s", "set", "a", None), ("t", "set", "b", None), ("l1", "layer", None, "L1"), ("l2", "layer", "b", "L2"), ("n", "analysis", None, "A"), ("h", "hook", None, "H")], "node string, node_type string, entity_type string, ref string")
    rule = spark.createDataFrame([("set", "layer", "backs", "entity_type_match"), ("layer", "analysis", "in", "layer_in_inputs"), ("analysis", "layer", "out", "layer_in_produces"), ("layer", "hook", "feeds", "layer_in_requires_or_optional"), ("set", "set", "sub", "always"), ("set", "hook", "x", "odd")], "from_type string, to_type string, edge_type string, constraint string")
    layers = spark.createDataFrame([("L1", "a"), ("L2", "")], "layer_id string, entity_type string")
    analyses = spark.createDataFrame([("A", "L1, L9", "L2")], "analysis_id string, input_layer_types string, produces string")
    hooks = spark.createDataFrame([("H", "", "L2")], "hook_id string, requires_layers string, optional_layers string")
    good = [("s", "l1", "backs"), ("t", "l2", "backs"), ("l1", "n", "in"), ("n", "l2", "out"), ("l2", "h", "feeds"), ("s", "t", "sub")]
    bad = {("t", "l1", "backs"): "entity_type_match", ("l2", "n", "in"): "layer_in_inputs", ("n", "l1", "out"): "layer_in_produces", ("l1", "h", "feeds"): "layer_in_requires_or_optional", ("s", "h", "x"): "unknown constraint", ("l1", "s", "sub"): "no_rule", ("q", "s", "sub"): "unknown_source", ("s", "q", "sub"): "unknown_target"}
    edges = spark.createDataFrame([*good, *bad], "src string, dst string, edge_type string")
    assert {tuple(r)[:3]: r.problem for r in graph.edge_violations(edges, nodes, rule, layers, analyses, hooks).collect()} == bad


def test_hierarchy(spark):
    """A sound chain passes all nine checks; with one fault each, each is listed."""

    def report(fault):
        df = lambda data, schema: spark.createDataFrame(data, schema)
        species = df([("s1",)] + [("s2",)] * (fault != 1), "species_id string")
        genomes = df([("g1", ["s1", "s2"])] if fault != 2 else [("g0", ["s1"])], "genome_id string, species_composition array<string>")
        chromosomes = df([("g1", "LG01")], "genome_id string, chrom string")
        cohorts = df([("c1", "g1", ["s1", "s2"], []), ("c2", "g1", ["s2", "s1"] if fault != 5 else ["s1"], ["c1"])], "cohort_id string, genome_id string, species_composition array<string>, parent_cohort_ids array<string>")
        samples = df([("c1", "x", "s1"), ("c1", "y", "s2" if fault != 4 else "s1"), ("c2", "x", "s1")] + [("c2", "y", "s2")] * (fault != 5), "cohort_id string, sample_id string, species string")
        groups = df([("p", "c1", None, "v1"), ("q", "c1" if fault != 6 else "c2", "p", "v1")], "group_id string, cohort_id string, parent_group_id string, created string")
        members = df([("p", "x" if fault != 7 else "z")], "group_id string, sample_id string")
        candidates = df([("i", "c1", "LG01" if fault != 8 else "LG99")], "candidate_id string, cohort_id string, chrom string")
        references = df([("evidence", "e", "c1" if fault != 3 else "c9")], "kind string, id string, cohort_id string")
        results = df([("r", "p", "v1" if fault != 9 else "v0")], "result_id string, group_id string, group_version string")
        out = registry.hierarchy_checks(species, genomes, chromosomes, cohorts, samples, groups, members, candidates, references, results)
        return [r["check"] for r in out.collect() if not r["pass"]]

    names = ["species of genomes", "genomes of cohorts", "cohorts of rows", "composition of cohorts", "parents of cohorts", "parents of groups", "members of groups", "chromosomes of candidates", "groups of results"]
    assert report(0) == []
    for k, name in enumerate(names, 1):
        assert name in report(k)


def test_fresh_versions(spark):
    existing = spark.createDataFrame([("a_v1",), ("a_v3",), ("b",), ("c_v2",)], "id string")
    proposed = spark.createDataFrame([(1, "a"), (2, "a"), (3, "c"), (4, "b")], "proposal int, base string")
    assert dict(rows(registry.fresh_versions(proposed, existing))) == {1: "a_v2", 2: "a_v4", 3: "c_v1", 4: "b_v1"}
    assert dict(rows(registry.fresh_versions(proposed, existing, most=3)))[2] == "a_v_TODO"


def test_ownership(spark):
    claims = spark.createDataFrame([(1, "k", "A", "x", False, None), (2, "k", "B", "x", False, None), (1, "p", "A", "x", True, None), (2, "p", "B", "y", False, None), (1, "t", "A", "x", False, "B"), (2, "t", "B", "y", False, None), (1, "c", "A", "x", False, None), (2, "c", "B", "y", False, None)], "seq int, key string, owner string, config string, provisional boolean, owned_by string")
    assert rows(registry.ownership(claims)) == [("c", "A", "conflict"), ("k", "A", "merge"), ("p", "B", "succeed"), ("t", "B", "transfer")]


def test_last_per_key_and_order(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "", "z")], "line int, id string, v string")
    assert rows(registry.last_per_key(df, "id", "line"), "id", "v") == [("a", "y")]
    names = spark.createDataFrame([("LG10",), ("LG2",), ("chrX",), ("LG1",)], "n string")
    assert [r.n for r in names.orderBy(*registry.natural_order(F.col("n"))).collect()] == ["LG1", "LG2", "LG10", "chrX"]
    files = spark.createDataFrame([("d/LG1_a.json", 5), ("d/LG1_b.json", 9), ("d/LG2.json", 1), ("d/x.json", 99)], "path string, bytes long")
    assert rows(registry.largest_per_key(files, r"LG\d+"), "key", "path") == [("LG1", "d/LG1_b.json"), ("LG2", "d/LG2.json")]


def test_ordered_difference(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "idx int, value string")
    b = spark.createDataFrame([(0, "x"), (1, "z"), (2, "w")], "idx int, value string")
    assert sorted(r.idx for r in registry.ordered_difference(a, b).collect()) == [1, 2]


def test_set_identity_is_independent_of_order(spark):
    df = spark.createDataFrame([("a", "CGA118"), ("a", "CGA042"), ("b", "CGA042"), ("b", "CGA118"), ("b", "CGA042")], "set_id string, member string")
    assert {r.sample_set_id for r in sets.set_ids(df).collect()} == {"sset_2def0587047196ae"}


def test_set_expressions(spark):
    groups = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "b"), ("h", "c")], "set_id string, member string")
    stored = spark.createDataFrame([("sset_1", "c")], "set_id string, member string")
    g, h, s = SetExpr.named("g"), SetExpr.named("h"), SetExpr.named("sset_1")
    run = lambda e: [r.member for r in members(e, groups, stored, {"late": lambda df: df.filter("member > 'a'")}).orderBy("member").collect()]
    assert run(g & h) == ["b"] and run(g | s) == ["a", "b", "c"] and run((g | h) - s) == ["a", "b"] and run(g.where("late")) == ["b"]
    assert (g & h).label() == "(g ∩ h)"
    with pytest.raises(KeyError):
        run(g.where("none"))


def test_scalars(spark):
    assert spark.range(1).select(scalars.fnv1a_32(F.lit("{}"))).first()[0] == "5465b825"
    assert spark.range(1).select(scalars.iso_utc(F.lit(0))).first()[0] == "1970-01-01T00:00:00Z"
    assert spark.range(1).select(stats.round_half_up(F.lit(0.285), 2)).first()[0] == 0.28
    assert scalars.object_key({"b": 1, "a": 2}) == scalars.object_key({"a": 2, "b": 1})
    assert scalars.cache_key("k", {"b": 1, "a": 2}, ["y", "x"]) == scalars.cache_key("k", {"a": 2, "b": 1}, ["x", "y"])
    assert scalars.fill_template("{a}/{b}", {"a": 1}, {"a": 2, "b": 3}) == "1/3"
    assert scalars.interpolate({"a": "x", "b": "${a}/y"}) == {"a": "x", "b": "x/y"}
    with pytest.raises(ValueError):
        scalars.interpolate({"a": "${b}.", "b": "${a}."})
    assert scalars.parse_scale("5k:5000:1000", {}) == ("5k", 5000, 1000)
    with pytest.raises(ValueError):
        scalars.parse_scale("x", {})


def test_requests():
    with pytest.raises(ValueError):
        Region("c", 5, 5)
    with pytest.raises(ValueError):
        ChunkRequest("c", 0, 5)
    with pytest.raises(ValueError):
        GroupRequest({"a": ["x", "x"]})
    known = GroupRequest({"a": ["x", "y", "z"]}, least=2).known({"x", "z"})
    assert known.groups == {"a": ["x", "z"]} and known.dropped == {"a": ["y"]}


def test_catalog(spark, tmp_path):
    c = Catalog(spark)
    c.register("n", lambda k: spark.range(k).withColumn("x", F.col("id")), "hot")
    assert c.resolve("n", k=3).count() == 3 and c.resolve("n", ["x", "nope"], k=3).columns == ["x"]
    assert c.resolve("n", k=3) is c.resolve("any:n", k=3)
    c.disabled.add("n")
    assert c.resolve("n", k=3) is None
    c.write("w", spark.range(2), str(tmp_path / "w"), "1")
    c.register_path("w", str(tmp_path) + "/{name}")
    assert c.resolve("w", name="w").count() == 2


def test_rules(spark):
    seg = spark.createDataFrame([("s", 1, "A", 6), ("s", 2, "B", 3), ("s", 3, "A", 1)], "k string, segment int, state string, n long")
    r = rules.recombinant_gate(seg, "k", 20_000).first()
    assert (r.dominant, round(r.deviation, 2), r.longest_bp, r.fires) == ("A", 0.3, 60_000, True)
    assert spark.range(1).select(rules.event_class(F.lit(10), F.lit(1))).first()[0] == "gene_conversion_embedded"
    stale = rules.stale(spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "k string, version int"), spark.createDataFrame([("a", 1), ("b", 3)], "k string, version int"), "k")
    assert sorted(r.k for r in stale.collect()) == ["b", "c"]


def test_dosage_codes_and_tajima(spark):
    cells = spark.createDataFrame([("0",), (" 2 ",), ("NA",), ("3",), ("",), (None,)], "c string")
    assert [r[0] for r in cells.select(stats.dosage_code(F.col("c"))).collect()] == [0, 2, -1, -1, -1, -1]
    assert spark.range(1).select(stats.tajima_d(F.lit(10), F.lit(0), F.lit(0.0))).first()[0] is None
    d = spark.range(1).select(stats.tajima_d(F.lit(10).cast("long"), F.lit(16), F.lit(3.888889))).first()[0]
    assert abs(d - -1.446172) < 1e-4


def test_combined_cohorts(spark):
    a = spark.createDataFrame([("s1",), ("s2",)], "sample_id string")
    assert sets.combine_cohorts(a, a, True, ["x"], ["x"]).count() == 2
    with pytest.raises(ValueError):
        sets.combine_cohorts(a, a, True, ["x"], ["y"])
    assert spark.range(1).select(sets.pair_name(F.lit("b"), F.lit("a"))).first()[0] == "a__vs__b"
