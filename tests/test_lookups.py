"""Lookups in registries on small tables, with nulls, repeats and ties."""

import pytest

from gridtally.operators import lookups
from gridtally.plans.requests import LdRequest
from gridtally.sources import delimited

RESULT = "result_id string, place long, analysis_type string, sample_set_id string, interval_set_id string, site_set_id string, input_value_id string, input_result_id string"
CONTRACT = "contract string, analysis_type string, sample_set_id string, interval_set_id string, site_set_id string, input_value_id string, input_result_id string"


def test_first_result_of_a_contract(spark):
    results = spark.createDataFrame([("r1", 1, "fst", "s", "", "", "v", ""), ("r2", 2, "fst", "s", None, "", "v", "up"), ("r3", 0, "fst", "s", "", "", "w", "up"), ("r4", 4, "pi", "s", "", "", None, None)], RESULT)
    contracts = spark.createDataFrame(
        [("value", "fst", "s", None, "", "v", None), ("input", "fst", "s", "", "", "x", "up"), ("both", "fst", "s", "", "", "v", "up"), ("none", "fst", "t", "", "", "v", "up"), ("empty", "pi", "s", "", "", "", ""), ("no_input", "fst", "s", "", "", "x", "")], CONTRACT
    )
    got = {r.contract: r.result_id for r in lookups.find_results(contracts, results).collect()}
    assert got == {"value": "r1", "input": "r3", "both": "r3", "none": None, "empty": "r4", "no_input": None}
    assert lookups.find_results(contracts.limit(0), results).count() == 0
    assert {r.result_id for r in lookups.find_results(contracts, results.limit(0)).collect()} == {None}


def test_wired_consumers_are_left_out(spark):
    results = spark.createDataFrame([("a", "fst", ""), ("b", "scan", "a"), ("c", "fst", None)], "result_id string, analysis_type string, input_result_id string")
    produces = spark.createDataFrame([("fst", "windows")], "analysis_type string, tag string")
    consumers = spark.createDataFrame([("windows", "scan/x"), ("windows", "scan/y"), ("windows", "plot"), ("windows", "plot")], "tag string, consumer string")
    got = sorted(map(tuple, lookups.unwired_consumers(results, produces, consumers).collect()))
    assert got == [("a", "plot"), ("c", "plot"), ("c", "scan/x"), ("c", "scan/y")]


def test_modules(spark):
    documents = ['{"name": "a", "ready": true, "last_run": {"qc_status": "ok", "started_at": 86400.9}}', '{"name": "b", "installed": null, "version": 2}', '{"name": "c", "stale": "True", "derivatives": ["x", "y"], "last_run": null}', "{", None]
    flat = lookups.flattened_modules(spark.createDataFrame([(x,) for x in documents], "document string"))
    rows = {r.module_name: r for r in flat.collect()}
    assert sorted(rows) == ["a", "b", "c"]
    assert (rows["a"].installed, rows["a"].last_run_started, rows["a"].last_run_qc) == ("true", "1970-01-02T00:00:00Z", "ok")
    assert (rows["b"].installed, rows["b"].version) == ("", "2") and (rows["c"].stale, rows["c"].derivatives, rows["c"].last_run_id) == ("true", "x,y", "")
    modes = spark.createDataFrame([("a ",), ("b",), ("c",), ("d",), (None,)], "module_name string")
    got = {r.module_name: (r.state, r.label) for r in lookups.module_states(modes, flat).collect()}
    assert got == {"a ": ("MOD_READY", "a  — last QC: ok"), "b": ("MOD_NOT_INSTALLED", "b 2"), "c": ("MOD_STALE", "c — stale: inputs changed"), "d": ("MOD_CONCEPTUAL", "d (not in module_registry)"), None: ("MOD_CONCEPTUAL", "(no module_name set)")}


def test_labels(spark):
    results = spark.createDataFrame([("own", "LG01", 1000, 2000000, ["e"]), ("chrom", "LG02", None, 5, None), ("told", None, None, None, ["x", "e", "f"]), ("guess", "", 1, 2, ["a_LG", "b_chr7_c"]), ("whole", None, None, None, ["q"]), ("bare", None, None, None, []), ("null", None, None, None, None)], "result_id string, chrom string, start long, end long, artifacts array<string>")
    envelopes = spark.createDataFrame([("e", "LG03", 5, 7000), ("f", "LG04", None, None), ("x", None, 1, 2)], "artifact_id string, chrom string, start long, end long")
    got = dict(map(tuple, lookups.labelled_results(results, envelopes).collect()))
    assert got == {"own": "LG01:1_000-2_000_000", "chrom": "LG02", "told": "LG03:5-7_000", "guess": "chr7", "whole": "whole-genome", "bare": "—", "null": "—"}


def test_numbered_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n  {"a": \n{"a": 2}\nwords\n')
    got = sorted((r._line, r.a, r._raw, r._error is not None) for r in delimited.numbered_json_lines(spark, str(tmp_path / "x.jsonl"), "a long").collect())
    assert got == [(1, 1, None, False), (3, None, '  {"a": ', True), (4, 2, None, False), (5, None, "words", True)]
    assert delimited.json_lines(spark, str(tmp_path / "absent.jsonl"), "a long", strict=True).collect() == []


@pytest.mark.parametrize("change", [{"window_range": (-1, 2)}, {"window_range": (3, 2)}, {"groups": {}}, {"groups": {"a": ["1"] * 4}}, {"groups": {"a-b": ["1"] * 5}}, {"groups": {str(i): ["1"] * 5 for i in range(5)}}, {"shelf": (5, 5)}, {"snp_cap": 9}])
def test_ld_requests(change):
    good = {"chrom": "LG01", "window_range": (0, 0), "groups": {"a_b": ["1", "2", "3", "4", "5"]}, "shelf": (1, 2), "snp_cap": 10}
    LdRequest(**good)
    with pytest.raises(ValueError):
        LdRequest(**{**good, **change})
