"""Registered queries of lookups in registries, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtally.operators import lookups
from gridtally.projections import table
from gridtally.registered import query
from gridtally.session import work_folder
from gridtally.sources import delimited

_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_LISTED = "[" + ", ".join(f"'{p}'" for p in _PRIORITIES) + "]"


def _s(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


@query(f"""WITH r AS (SELECT o_orderkey AS id, o_orderpriority AS t, o_custkey AS s, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS i, CASE WHEN o_orderkey % 3 > 0 THEN 'v' || o_orderkey % 3 ELSE '' END AS v, CASE WHEN o_orderkey % 5 < 2 THEN '' ELSE 'i' || o_orderkey % 4 END AS n FROM orders),
c AS (SELECT c_custkey AS id, {_LISTED}[c_custkey % 5 + 1] AS t, CASE WHEN c_nationkey % 2 = 0 THEN 'F' WHEN c_nationkey % 3 = 0 THEN '' ELSE 'O' END AS i, CASE WHEN c_custkey % 4 > 0 THEN 'v' || c_custkey % 4 ELSE '' END AS v, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'i' || c_custkey % 5 END AS n FROM customer)
SELECT c.id AS contract, min(r.id)::VARCHAR AS result_id, CASE WHEN min(r.id) IS NOT NULL THEN 'RESULT_READY' WHEN c.id % 3 = 0 THEN 'MISSING' WHEN c.id % 3 = 1 AND c.id % 2 = 0 THEN 'BLOCKED' ELSE 'RUN_READY' END AS state
FROM c LEFT JOIN r ON r.t = c.t AND r.s = c.id AND r.i = c.i AND (r.v = c.v OR r.n <> '' AND r.n = c.n) GROUP BY c.id""")
def contract_lookup(spark, d):
    """The first result of each contract, by its input's value or by the result that it comes from, and the contract's state."""
    o, c = F.col("o_orderkey"), F.col("c_custkey")
    value = lambda k, n: F.when(k % n > 0, F.concat(F.lit("v"), _s(k % n)))
    results = table(spark, d, "orders").select(_s(o).alias("result_id"), o.alias("place"), F.col("o_orderpriority").alias("analysis_type"), _s("o_custkey").alias("sample_set_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("interval_set_id"), F.lit("").alias("site_set_id"), value(o, 3).alias("input_value_id"), F.when(o % 5 >= 2, F.concat(F.lit("i"), _s(o % 4))).alias("input_result_id"))
    interval = F.when(F.col("c_nationkey") % 2 == 0, "F").when(F.col("c_nationkey") % 3 == 0, "").otherwise("O")
    contracts = table(spark, d, "customer").select(c.alias("contract"), F.get(F.array(*map(F.lit, _PRIORITIES)), (c % 5).cast("int")).alias("analysis_type"), _s(c).alias("sample_set_id"), interval.alias("interval_set_id"), F.lit(None).cast("string").alias("site_set_id"), value(c, 4).alias("input_value_id"), F.when(c % 7 == 0, "").otherwise(F.concat(F.lit("i"), _s(c % 5))).alias("input_result_id"))
    found = lookups.find_results(contracts, results)
    k = F.col("contract")
    missing = F.when(k % 3 == 0, F.array(F.lit("site_set_id")))
    ambiguous = F.when((k % 3 <= 1) & (k % 2 == 0), F.array(F.lit("interval_set_id")))
    return found.select("contract", "result_id", lookups.contract_state(F.col("result_id"), missing, ambiguous).alias("state"))


@query(f"""WITH r AS (SELECT o_orderkey AS id, o_orderpriority AS t, o_orderkey // 2 AS n FROM orders), c(tag, k) AS (VALUES ('a', '2-HIGH/x'), ('a', '5-LOW/y'), ('b', '1-URGENT/z'), ('b', '3-MEDIUM')), p(t, tag) AS (VALUES ('1-URGENT', 'a'), ('2-HIGH', 'b'), ('5-LOW', 'a'))
SELECT r.id::VARCHAR AS result_id, k AS consumer FROM r JOIN p ON p.t = r.t JOIN c ON c.tag = p.tag WHERE NOT EXISTS (SELECT 1 FROM r x WHERE x.n = r.id AND x.t = split_part(k, '/', 1))""")
def unwired_consumers(spark, d):
    """What could go on from each result, and doesn't yet."""
    o = F.col("o_orderkey")
    results = table(spark, d, "orders").select(_s(o).alias("result_id"), F.col("o_orderpriority").alias("analysis_type"), _s(F.floor(o / 2)).alias("input_result_id"))
    produces = spark.createDataFrame([("1-URGENT", "a"), ("2-HIGH", "b"), ("5-LOW", "a")], "analysis_type string, tag string")
    consumers = spark.createDataFrame([("a", "2-HIGH/x"), ("a", "5-LOW/y"), ("b", "1-URGENT/z"), ("b", "3-MEDIUM")], "tag string, consumer string")
    return lookups.unwired_consumers(results, produces, consumers)


def _modules(spark, d):
    k, n = _s("p_partkey"), F.col("p_size")
    version = F.when(n % 3 == 0, "null").otherwise(F.concat(F.lit('"'), _s(n), F.lit('"')))
    installed = F.when(n % 5 == 0, ', "installed": false').when(n % 5 == 1, ', "installed": null').when(n % 5 == 2, ', "installed": "TRUE"').otherwise("")
    flags = F.concat(F.when(n % 7 == 0, ', "stale": true').otherwise(""), F.when(n % 2 == 0, ', "ready": true').otherwise(', "ready": "no"'))
    started = F.when(n % 4 == 0, F.concat(F.lit('"started_at": '), _s(F.col("p_partkey") * 86400 + 5))).otherwise('"started_at": "2024-01-02"')
    run = F.concat(F.lit(', "last_run": {"status": "'), F.when(n % 11 == 0, "failed").otherwise("done"), F.lit('", "n_samples": '), _s(n), F.lit(", "), started, F.lit("}"))
    document = F.concat(F.lit('{"name": "m'), k, F.lit('", "version": '), version, installed, flags, run, F.lit(', "derivatives": ["a", "b"]}'))
    return lookups.flattened_modules(table(spark, d, "part").select(document.alias("document")))


_MODULES = """m AS (SELECT 'm' || p_partkey AS module_name, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_size::VARCHAR END AS version, CASE p_size % 5 WHEN 0 THEN 'false' WHEN 1 THEN '' ELSE 'true' END AS installed, CASE WHEN p_size % 7 = 0 THEN 'true' ELSE '' END AS stale, CASE WHEN p_size % 2 = 0 THEN 'true' ELSE '' END AS ready,
CASE WHEN p_size % 11 = 0 THEN 'failed' ELSE 'done' END AS last_run_status, p_size::VARCHAR AS n_samples, CASE WHEN p_size % 4 = 0 THEN strftime(make_timestamp((p_partkey * 86400 + 5) * 1000000), '%Y-%m-%dT%H:%M:%SZ') ELSE '2024-01-02' END AS last_run_started, 'a,b' AS derivatives FROM part)"""


@query(f"WITH {_MODULES} SELECT * FROM m")
def flat_modules(spark, d):
    """Modules' documents as rows of texts."""
    return _modules(spark, d).select("module_name", "version", "installed", "stale", "ready", "last_run_status", "n_samples", "last_run_started", "derivatives")


@query(f"""WITH {_MODULES}, o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'm' || o_custkey END AS name FROM orders)
SELECT o_orderkey, CASE WHEN name = '' OR m.module_name IS NULL THEN 'MOD_CONCEPTUAL' WHEN installed <> 'true' THEN 'MOD_NOT_INSTALLED' WHEN last_run_status = 'failed' THEN 'MOD_FAILED' WHEN stale = 'true' THEN 'MOD_STALE' WHEN ready = 'true' THEN 'MOD_READY' ELSE 'MOD_AVAILABLE' END AS state,
CASE WHEN name = '' THEN '(no module_name set)' WHEN m.module_name IS NULL THEN name || ' (not in module_registry)' WHEN installed <> 'true' THEN name || ' ' || version WHEN last_run_status = 'failed' THEN name || ' ' || version || ' — last run failed' WHEN stale = 'true' THEN name || ' — stale: inputs changed' WHEN ready = 'true' THEN name || ' ' || version || ' — last QC: ?' ELSE name || ' ' || version END AS label
FROM o LEFT JOIN m ON m.module_name = o.name""")
def module_statuses(spark, d):
    """The state and label of each order's module; not every number of a customer is a module's."""
    k = F.col("o_orderkey")
    modes = table(spark, d, "orders").select("o_orderkey", F.when(k % 13 == 0, " ").otherwise(F.concat(F.lit(" m"), _s("o_custkey"))).alias("module_name"))
    return lookups.module_states(modes, _modules(spark, d)).select("o_orderkey", "state", "label")


@query("""WITH l AS (SELECT o_orderkey AS k, o_orderpriority AS p, o_orderstatus AS s, count(*) AS n, min(l_partkey)::VARCHAR AS least, count(*) FILTER (l_returnflag = 'R') AS many, count(*) FILTER (l_linestatus = 'O') AS arts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT k, n > 1 OR p = '1-URGENT' AS of_set, CASE WHEN s = 'F' THEN 'given' WHEN n = 1 AND p IN ('2-HIGH', '5-LOW') THEN least ELSE '' END AS parent, n > 1 OR arts > 1 OR many > 0 AS of_analysis FROM l""")
def definition_needs(spark, d):
    """Which orders, as sets of their lines and as analyses of them, need more than a row; and their parent."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(_s("l_partkey"))).alias("parents"), F.collect_list(F.when(F.col("l_returnflag") == "R", "many").otherwise("one")).alias("cardinalities"), F.collect_list(F.when(F.col("l_linestatus") == "O", F.col("l_linenumber"))).alias("artifacts"))
    op = F.when(F.col("o_orderpriority") == "1-URGENT", "filter").when(F.col("o_orderpriority") == "2-HIGH", "from_set").when(F.col("o_orderpriority") == "5-LOW", "from_group").otherwise("union")
    given = F.when(F.col("o_orderstatus") == "F", "given").when(F.col("o_orderstatus") == "P", "")
    of_set, of_analysis = lookups.set_needs_definition(op, F.col("parents")), lookups.analysis_needs_definition(F.col("cardinalities"), F.col("artifacts"), F.array())
    return o.join(lines, "o_orderkey").select(F.col("o_orderkey").alias("k"), of_set.alias("of_set"), lookups.single_parent(given, op, F.col("parents")).alias("parent"), of_analysis.alias("of_analysis"))


def _shown(n: str) -> str:
    return f"replace(format('{{:,}}', {n}), ',', '_')"


@query(f"""WITH a AS (SELECT l_orderkey AS k, l_linenumber AS ln, l_partkey AS p, 'art_' || CASE WHEN l_linenumber % 3 = 0 THEN 'LG' || l_partkey % 30 ELSE 'LGx' END || '_' || l_partkey AS id FROM lineitem WHERE l_returnflag <> 'A'),
e AS (SELECT k, first(CASE WHEN p_size % 4 = 1 THEN 'chr' || p_size ELSE 'chr' || p_size || ':' || {_shown('p_partkey * 1000')} || '-' || {_shown('p_partkey * 1000 + 5000')} END ORDER BY ln, id) AS told FROM a JOIN part ON p_partkey = p WHERE p_size % 2 = 1 AND p_size < 12 GROUP BY k),
g AS (SELECT k, first(CASE WHEN ln % 3 = 0 THEN 'LG' || p % 30 END ORDER BY ln, id) FILTER (ln % 3 = 0) AS guess FROM a GROUP BY k)
SELECT o_orderkey::VARCHAR AS result_id, CASE WHEN o_orderkey % 5 = 0 THEN 'LG01:' || {_shown('o_custkey')} || '-' || {_shown('o_custkey + 100000')} WHEN o_orderkey % 5 = 1 AND o_orderkey % 2 = 0 THEN 'LG02' WHEN e.told IS NOT NULL THEN e.told WHEN g.k IS NULL THEN '—' ELSE coalesce(guess, 'whole-genome') END AS label
FROM orders LEFT JOIN e ON e.k = o_orderkey LEFT JOIN g ON g.k = o_orderkey""")
def result_labels(spark, d):
    """Labels of results by their interval, an artifact's, or an artifact's name."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    artifact = F.concat(F.lit("art_"), F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("LG"), _s(F.col("l_partkey") % 30))).otherwise("LGx"), F.lit("_"), _s("l_partkey"))
    lines = table(spark, d, "lineitem").filter("l_returnflag <> 'A'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", artifact.alias("id"))
    held = lines.groupBy("o_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "id"))), lambda x: x["id"]).alias("artifacts"))
    own = F.when(k % 5 == 0, "LG01").when((k % 5 == 1) & (k % 2 == 0), "LG02").when(k % 3 == 0, "")
    results = table(spark, d, "orders").select("o_orderkey", own.alias("chrom"), F.when(k % 5 == 0, c).alias("start"), F.when(k % 5 == 0, c + 100000).alias("end")).join(held, "o_orderkey", "left").withColumn("result_id", _s("o_orderkey"))
    p, n = F.col("p_partkey"), F.col("p_size")
    coordinates = table(spark, d, "part").select(p.alias("l_partkey"), F.when((n % 2 == 1) & (n < 12), F.concat(F.lit("chr"), _s(n))).alias("chrom"), F.when(n % 4 != 1, p * 1000).alias("start"), (p * 1000 + 5000).alias("end"))
    envelopes = lines.select(F.col("id").alias("artifact_id"), "l_partkey").distinct().join(coordinates, "l_partkey").drop("l_partkey")
    return lookups.labelled_results(results, envelopes)


@query("""SELECT CASE WHEN o_orderkey % 10 <> 3 THEN o_orderkey END AS o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN '{"o_orderkey": ' || o_orderkey || ', "cut' END AS raw, o_orderkey % 10 = 3 AS bad FROM orders""")
def bad_json_lines(spark, d):
    """JSON lines of which a tenth is cut off: those stay as text, with an error and their line."""
    path, k = work_folder(spark), _s("o_orderkey")
    line = F.concat(F.lit('{"o_orderkey": '), k, F.when(F.col("o_orderkey") % 10 == 3, ', "cut').otherwise("}"))
    table(spark, d, "orders").select(line.alias("line")).write.text(path)
    found = delimited.numbered_json_lines(spark, path, "o_orderkey long")
    return found.select("o_orderkey", F.col("_raw").alias("raw"), (F.col("_error").isNotNull() & (F.col("_line") > 0)).alias("bad"))
