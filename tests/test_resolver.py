"""Requests one by one: every status, and the texts of messages and log."""

import pytest

from gridtally.operators import resolver

MODES = [
    (1, "rel", "genome", "Whole", "res", "sample_set", "genome_all", "thin500_global", "family_population", "beagle_matching"),
    (2, "rel", "chrom", "Chrom", "res", "sample_set, chromosome", "chromosome_full", "thin500_per_chr", "family_karyotype", "beagle_matching"),
    (3, "rel", "cand", "Cand", "res", "sample_set", "candidate_interval", "candidate_sites", "optional_groups", "none"),
    (4, "ped", "global", "Ped", "ped", "ngsrelate_result", "same_as_input", "same_as_input", "same_as_input", "none"),
    (5, "rel", "odd", "Odd", "", "colour", "", "", "", ""),
    (6, "rel", "new", "New", "", "", "weird", "karyotype_calls", "", "other"),
    (9, "rel", "genome", "Twice", "res", "nothing", "", "", "", ""),
]
INTERVALS = [("g1", "genome", ""), ("c_LG01", "chromosome", "x"), ("c_LG02", "chromosome", "x"), ("c_LG02b", "chromosome", "x"), ("odd", "chromosome", "p/LG07.bed"), ("cand_A1", "candidate", "")]
SITES = [("thin500_global", "g1", ""), ("thin500_LG01", "c_LG01", ""), ("s_A1", "cand_A1", "intersect"), ("s_A1b", "cand_A1", "intersect")]
GROUPS = [("fp", "S", "family,population"), ("fp1", "T", "family,population"), ("fp2", "T", "population,family")]
VALUES = [("v1", "BEAGLE", "S", "thin500_global", "g1"), ("v2", "BEAGLE_GL", "S", "thin500_LG01", "c_LG01"), ("v3", "VCF", "S", "thin500_global", "g1")]
RESULTS = [("r1", "S", "g1", "thin500_global", "fp"), ("r2", "S", "", "", "")]
NAMES = "sample_set chromosome candidate_id ngsrelate_result pedigree_result candidate_set group_set".split()


@pytest.fixture(scope="module")
def ask(spark):
    def run(asked):
        rows = [(k, *mode.split("/"), *(given.get(n) for n in NAMES)) for k, (mode, given) in asked.items()]
        frame = lambda data, names: spark.createDataFrame(data, ", ".join(f"{n} string" for n in names.split()))
        requests = frame(rows, "request analysis mode " + " ".join(NAMES))
        modes = spark.createDataFrame(MODES, "line_no int, analysis_type string, mode string, label string, produces string, required_dimensions string, interval_policy string, site_policy string, group_policy string, value_policy string")
        out = resolver.resolve(requests, modes, frame(INTERVALS, "interval_set_id interval_type path"), frame(SITES, "site_set_id interval_set_id operation"), frame(GROUPS, "group_set_id sample_set_id group_columns"), frame(VALUES, "value_id value_type sample_set_id site_set_id interval_set_id"), frame(RESULTS, "result_id sample_set_id interval_set_id site_set_id group_set_id"))
        return {r.request: r for r in out.collect()}

    return run


def test_every_status(ask):
    s = {"sample_set": "S"}
    got = ask({
        "ok": ("rel/genome", s), "none": ("rel/genome", {}), "two groups": ("rel/genome", {"sample_set": "T"}), "explicit": ("rel/genome", {"sample_set": "T", "group_set": "mine"}),
        "chrom": ("rel/chrom", s | {"chromosome": "LG01"}), "path": ("rel/chrom", s | {"chromosome": "LG07"}), "two": ("rel/chrom", s | {"chromosome": "LG02"}), "no": ("rel/chrom", s | {"chromosome": "LG99"}),
        "cand": ("rel/cand", s | {"candidate_id": "A1"}), "no cand": ("rel/cand", s), "ped": ("ped/global", {"ngsrelate_result": "r1"}), "lost": ("ped/global", {"ngsrelate_result": "r9"}), "bare": ("ped/global", {"ngsrelate_result": "r2"}),
        "colour": ("rel/odd", s), "unknown": ("rel/zzz", s), "new": ("rel/new", s), "upstream": ("rel/genome", {"sample_set": "T", "pedigree_result": "r1"}),
    })
    ids = lambda k: (got[k].interval_set_id, got[k].site_set_id, got[k].group_set_id, got[k].input_value_id)
    assert {k: r.status for k, r in got.items()} == {"ok": "ok", "none": "missing", "two groups": "missing", "explicit": "missing", "chrom": "missing", "path": "missing", "two": "missing", "no": "missing", "cand": "ambiguous", "no cand": "missing", "ped": "ok", "lost": "invalid", "bare": "missing", "colour": "missing", "unknown": "invalid", "new": "missing", "upstream": "missing"}
    assert ids("ok") == ("g1", "thin500_global", "fp", "v1") and got["ok"].produces == "res"
    assert got["ok"].log == ["mode: rel/genome  (Whole)", "interval_policy='genome_all': interval_type=genome → g1", "site_policy='thin500_global': site_set name contains 'thin500' and 'global' → thin500_global", "group_policy='family_population': group_columns contain 'family' and 'population' → fp", "value_policy='beagle_matching': BEAGLE matching (S, thin500_global, g1) → v1"]
    assert got["none"].missing == ["required dimension 'sample_set' not provided (use --sample-set)"] and got["none"].sample_set_id is None
    assert got["two groups"].ambiguities == ["group_policy='family_population': family+population (need exactly 1)"] and got["two groups"].group_candidates == 2
    assert ids("explicit")[2] == "mine" and got["explicit"].ambiguities == [] and "group (explicit): mine" in got["explicit"].log
    assert ids("chrom") == ("c_LG01", "thin500_LG01", None, "v2") and got["chrom"].missing == ["group_policy='family_karyotype': no group_set with family+karyotype columns; consider --group-set explicitly"]
    assert ids("path")[0] == "odd" and got["two"].ambiguities == ["interval_policy='chromosome_full': interval_type=chromosome matching 'LG02'"] and got["two"].interval_candidates == 2
    assert "interval_policy='chromosome_full': interval_type=chromosome matching 'LG99'" in got["no"].missing
    assert ids("cand") == ("cand_A1", None, "", "") and got["cand"].ambiguities == ["site_policy='candidate_sites': intersect site_set on interval=cand_A1"]
    assert got["cand"].log[-1].endswith("→ (none)") and got["cand"].log[-2].endswith("leaving empty → (no unique match)") and got["no cand"].missing[0].endswith("need --candidate-id")
    assert ids("ped") == ("g1", "thin500_global", "fp", "") and got["ped"].input_result_id == "r1" and got["ped"].log[:2] == ["mode: ped/global  (Ped)", "inherits from upstream r1: sample=S, interval=g1"] and got["ped"].sample_set_id == "S"
    assert got["lost"].missing == ["upstream result 'r9' not in analysis_results"] and got["unknown"].missing == ["no mode 'rel/zzz' in analysis_modes"] and got["unknown"].log == []
    assert [m.split(":")[1].strip() for m in got["bare"].missing] == [f"unknown {d}_policy 'same_as_input'" for d in ("interval", "site", "group")]
    assert got["colour"].missing == ["required dimension 'colour' not provided (use --colour)"] and len(got["new"].missing) == 3
    assert got["upstream"].sample_set_id == "T" and got["upstream"].input_result_id == "r1"
