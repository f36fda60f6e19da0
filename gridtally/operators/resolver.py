"""Analysis requests resolved to contracts by the policies of their mode, a set of requests at a time.

Each policy names candidates by a key (a chromosome, an interval set, a sample set). Candidates are counted once per key, however many
requests have it, and exactly one settles the dimension. "Contains" is an equi-join on the substrings that have a key's length.
Dimensions follow each other, as sites depend on the interval and values on both; what an upstream result had is inherited
where the policy says so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ["sample_set", "chromosome", "candidate_id", "ngsrelate_result", "pedigree_result", "candidate_set", "group_set"]
CONTRACT = ["input_result_id", "sample_set_id", "interval_set_id", "site_set_id", "group_set_id", "input_value_id"]


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def containing(keys: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """(key, id) for rows (id, text) whose text contains a key of keys (key)."""
    sizes = [r.n for r in keys.filter("key <> ''").select(F.length("key").alias("n")).distinct().collect()]  # as many as keys have lengths
    if not sizes:
        return rows.select(F.lit("").alias("key"), "id").limit(0)
    def parts(n):
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.substring(F.col(text), i, F.lit(n)))

    every = F.array_distinct(F.flatten(F.array(*map(parts, sizes))))
    return rows.select("id", F.explode(every).alias("key")).join(keys.filter("key <> ''").select("key").distinct(), "key", "left_semi").select("key", "id")


def _tagged(matches: DataFrame, tag: str, key: Column | str = "key") -> DataFrame:
    return matches.select(F.lit(tag).alias("tag"), (F.col(key) if isinstance(key, str) else key).alias("key"), F.col("id"))


def interval_candidates(interval_sets: DataFrame, requests: DataFrame) -> DataFrame:
    """(tag, key, id): genome sets; chromosome sets whose id, or else whose path, contains the chromosome; candidate sets whose id contains the candidate."""
    rows = interval_sets.select(F.col("interval_set_id").alias("id"), "interval_type", _text("path").alias("path"))
    of = lambda kind: rows.filter(F.col("interval_type") == kind)
    asked = lambda c: requests.select(F.col(c).alias("key")).distinct()
    by_id = containing(asked("chromosome"), of("chromosome"), "id")
    by_path = containing(asked("chromosome").join(by_id, "key", "left_anti"), of("chromosome"), "path")
    return reduce(DataFrame.union, [_tagged(of("genome"), "genome_all", F.lit("")), _tagged(by_id.union(by_path), "chromosome_full"), _tagged(containing(asked("candidate_id"), of("candidate"), "id"), "candidate_interval")])


def site_candidates(site_sets: DataFrame) -> DataFrame:
    rows = site_sets.select(F.col("site_set_id").alias("id"), _text("interval_set_id").alias("key"), _text("operation").alias("operation"))
    thin = rows.filter(F.contains("id", F.lit("thin500")))
    return reduce(DataFrame.union, [_tagged(thin.filter(F.contains("id", F.lit("global"))), "thin500_global", F.lit("")), _tagged(thin, "thin500_per_chr"), _tagged(rows.filter("operation = 'intersect'"), "candidate_sites")])


def group_candidates(group_sets: DataFrame) -> DataFrame:
    rows = group_sets.select(F.col("group_set_id").alias("id"), _text("sample_set_id").alias("key"), _text("group_columns").alias("columns"))
    family = rows.filter(F.contains("columns", F.lit("family")))
    return _tagged(family.filter(F.contains("columns", F.lit("population"))), "family_population").union(_tagged(family.filter(F.contains("columns", F.lit("karyotype"))), "family_karyotype"))


def value_key(sample: Column, site: Column, interval: Column) -> Column:
    """What a value file must match; an empty interval matches any."""
    return F.to_json(F.struct(sample.alias("a"), site.alias("b"), F.nullif(interval, F.lit("")).alias("c")))


def value_candidates(input_values: DataFrame) -> DataFrame:
    rows = input_values.filter(F.startswith(_text("value_type"), F.lit("BEAGLE")))
    keys = F.array_distinct(F.array(*(value_key(_text("sample_set_id"), _text("site_set_id"), i) for i in (_text("interval_set_id"), F.lit("")))))
    return rows.select(F.lit("beagle_matching").alias("tag"), F.explode(keys).alias("key"), F.col("value_id").alias("id"))


def _settled(rows: DataFrame, dim: str, target: str, candidates: DataFrame, key: Column, given: Column, given_log: Column, why: Column, chosen_empty: Column) -> DataFrame:
    """rows with the dimension's target, and its message appended to missing, ambiguities and log.

    given: a value that needs no policy; chosen_empty: true where the policy chooses to have none.
    """
    policy = F.col(f"{dim}_policy")
    counted = candidates.groupBy("tag", "key").agg(F.count("*").alias("_n"), F.min("id").alias("_id"))
    joined = rows.withColumn("_key", key).join(counted, (policy == counted["tag"]) & (F.col("_key") == counted["key"]), "left").drop("tag", "key")
    n = F.coalesce("_n", F.lit(0))
    asks = (policy != "") & given.isNull() & F.col("open")
    found = F.when(n == 1, F.col("_id"))
    said = F.concat(F.lit(f"{dim}_policy='"), policy, F.lit("': "), why)
    failed = asks & ~chosen_empty & found.isNull()
    add = lambda to, when, what: F.when(when, F.array_append(to, what)).otherwise(F.col(to))
    line = F.concat(said, F.lit(" → "), F.when(chosen_empty & (policy == "none"), "(none)").otherwise(F.coalesce(found, F.lit("(no unique match)"))))
    out = joined.withColumns({
        f"{dim}_candidates": F.when(asks, n).otherwise(0).cast("long"),
        "missing": add("missing", failed & (n == 0), said),
        "ambiguities": add("ambiguities", failed & (n > 1), said),
        "log": F.when(F.col("open") & given.isNotNull(), F.array_append("log", given_log)).when(asks, F.array_append("log", line)).otherwise(F.col("log")),
        target: F.when(F.col("open"), F.coalesce(given, F.when(asks, F.coalesce(found, F.when(chosen_empty, F.lit("")))))),
    })
    return out.drop("_key", "_n", "_id")


def resolve(requests: DataFrame, modes: DataFrame, interval_sets: DataFrame, site_sets: DataFrame, group_sets: DataFrame, input_values: DataFrame, results: DataFrame) -> DataFrame:
    """(request, status, analysis_type, mode, produces, the contract's ids, missing, ambiguities, log, *_candidates) for each request.

    requests: request, analysis, mode and DIMENSIONS, null or empty where not given. A mode that isn't there, or an upstream result that isn't,
    is invalid; a required dimension that isn't given ends the matter as missing; else missing, ambiguous or ok follows from
    the four policies. Where a mode is listed twice the first counts (by line_no).
    """
    asked = requests.select("request", F.col("analysis").alias("analysis_type"), "mode", *(_text(c).alias(c) for c in DIMENSIONS))
    policies = [f"{d}_policy" for d in ("interval", "site", "group", "value")]
    known = modes.groupBy("analysis_type", "mode").agg(F.min_by(F.struct("label", "produces", "required_dimensions", *policies), "line_no").alias("m"))
    rows = asked.join(known, ["analysis_type", "mode"], "left")
    rows = rows.select(*asked.columns, F.col("m").isNotNull().alias("known"), *(F.coalesce(f"m.{c}", F.lit("")).alias(c) for c in ("label", "produces", "required_dimensions", *policies)))

    required = F.filter(F.transform(F.split("required_dimensions", ","), lambda x: F.trim(x)), lambda x: x != "")
    have = F.array_compact(F.array(*(F.when(F.col(c) != "", F.lit(c)) for c in DIMENSIONS)))
    lacking = F.transform(F.filter(required, lambda x: ~F.array_contains(have, x)), lambda x: F.concat(F.lit("required dimension '"), x, F.lit("' not provided (use --"), F.replace(x, F.lit("_"), F.lit("-")), F.lit(")")))
    upstream = F.coalesce(F.nullif("ngsrelate_result", F.lit("")), F.nullif("pedigree_result", F.lit("")))
    rows = rows.withColumn("lacking", lacking).withColumn("upstream", F.when(F.col("known") & (F.size("lacking") == 0), upstream))
    had = results.select(F.col("result_id").alias("upstream"), F.struct(*(_text(c).alias(c) for c in CONTRACT[1:5])).alias("had"))
    rows = rows.join(had, "upstream", "left")
    lost = F.col("upstream").isNotNull() & F.col("had").isNull()
    none = F.array().cast("array<string>")
    unknown = F.array(F.concat(F.lit("no mode '"), "analysis_type", F.lit("/"), "mode", F.lit("' in analysis_modes")))
    absent = F.array(F.concat(F.lit("upstream result '"), "upstream", F.lit("' not in analysis_results")))
    head = F.concat(F.lit("mode: "), "analysis_type", F.lit("/"), "mode", F.lit("  ("), "label", F.lit(")"))
    inherits = F.concat(F.lit("inherits from upstream "), "upstream", F.lit(": sample="), "had.sample_set_id", F.lit(", interval="), "had.interval_set_id")
    rows = rows.withColumns({
        "open": F.col("known") & (F.size("lacking") == 0) & ~lost,
        "missing": F.when(~F.col("known"), unknown).when(F.size("lacking") > 0, F.col("lacking")).when(lost, absent).otherwise(none),
        "ambiguities": none,
        "log": F.when(~F.col("known"), none).when(F.col("had").isNotNull(), F.array(head, inherits)).otherwise(F.array(head)),
        "input_result_id": F.when(~lost, F.col("upstream")),
    }).withColumn("sample_set_id", F.when(F.col("open"), F.coalesce(F.nullif("sample_set", F.lit("")), "had.sample_set_id", F.lit(""))))

    inherited = lambda dim, column: F.when((F.col(f"{dim}_policy") == "same_as_input") & (F.col(f"had.{column}") != ""), F.col(f"had.{column}"))
    said = lambda dim, column: F.concat(F.lit(f"{dim} (inherited): "), F.col(f"had.{column}"))
    never, n = F.lit(False), F.coalesce("_n", F.lit(0))
    quoted = lambda what, column: F.concat(F.lit(f"{what} '"), F.col(column), F.lit("'"))

    p = F.col("interval_policy")
    key = F.when(p == "chromosome_full", F.col("chromosome")).when(p == "candidate_interval", F.col("candidate_id")).otherwise("")
    why = (
        F.when(p == "genome_all", F.when(n == 1, "interval_type=genome").otherwise("interval_type=genome (need exactly 1)"))
        .when((p == "chromosome_full") & (F.col("chromosome") == ""), "need --chromosome")
        .when(p == "chromosome_full", F.when(n == 1, quoted("interval_type=chromosome containing", "chromosome")).otherwise(quoted("interval_type=chromosome matching", "chromosome")))
        .when((p == "candidate_interval") & (F.col("candidate_id") == ""), "need --candidate-id")
        .when(p == "candidate_interval", quoted("interval_type=candidate matching", "candidate_id"))
        .otherwise(quoted("unknown interval_policy", "interval_policy"))
    )
    rows = _settled(rows, "interval", "interval_set_id", interval_candidates(interval_sets, asked), key, inherited("interval", "interval_set_id"), said("interval", "interval_set_id"), why, never)

    p, interval = F.col("site_policy"), F.coalesce("interval_set_id", F.lit(""))
    key = F.when(p.isin("thin500_per_chr", "candidate_sites"), interval).otherwise("")
    why = (
        F.when(p == "thin500_global", F.when(n == 1, "site_set name contains 'thin500' and 'global'").otherwise("site name contains thin500+global (need exactly 1)"))
        .when(p == "thin500_per_chr", F.concat(F.when(n == 1, "thin500 site_set with interval_set_id=").otherwise("thin500 + interval_set_id="), interval))
        .when(p == "candidate_sites", F.when(n == 1, F.concat(F.lit("site_set with interval_set_id="), interval, F.lit(" and operation=intersect"))).otherwise(F.concat(F.lit("intersect site_set on interval="), interval)))
        .when(p == "karyotype_calls", "karyotype_calls policy not implemented yet (no example data)")
        .otherwise(quoted("unknown site_policy", "site_policy"))
    )
    rows = _settled(rows, "site", "site_set_id", site_candidates(site_sets), key, inherited("site", "site_set_id"), said("site", "site_set_id"), why, never)

    p = F.col("group_policy")
    relevant = group_sets.select(_text("sample_set_id").alias("sample_set_id")).distinct().withColumn("relevant", F.lit(True))
    rows = rows.join(relevant, "sample_set_id", "left")
    why = (
        F.when(p == "family_population", F.when(n == 1, "group_columns contain 'family' and 'population'").otherwise("family+population (need exactly 1)"))
        .when((p == "family_karyotype") & (n == 0) & F.col("relevant"), "no group_set with family+karyotype columns; consider --group-set explicitly")
        .when(p == "family_karyotype", F.when(n == 1, "group_columns contain 'family' and 'karyotype'").otherwise("family+karyotype (need exactly 1)"))
        .when(p == "optional_groups", "groups optional; leaving empty")
        .otherwise(quoted("unknown group_policy", "group_policy"))
    )
    explicit = F.nullif("group_set", F.lit(""))
    given_log = F.when(explicit.isNotNull(), F.concat(F.lit("group (explicit): "), explicit)).otherwise(said("group", "group_set_id"))
    rows = _settled(rows, "group", "group_set_id", group_candidates(group_sets), F.coalesce("sample_set_id", F.lit("")), F.coalesce(explicit, inherited("group", "group_set_id")), given_log, why, p == "optional_groups")

    p = F.col("value_policy")
    of = [F.coalesce(c, F.lit("")) for c in ("sample_set_id", "site_set_id", "interval_set_id")]
    why = F.when(p == "none", "this analysis consumes an upstream result, not a value file").when(p == "beagle_matching", F.concat(F.lit("BEAGLE matching ("), F.concat_ws(", ", *of), F.lit(")"))).otherwise(quoted("unknown value_policy", "value_policy"))
    rows = _settled(rows, "value", "input_value_id", value_candidates(input_values), value_key(*of), F.lit(None).cast("string"), F.lit(""), why, p == "none")

    status = F.when(~F.col("known") | lost, "invalid").when(F.size("missing") > 0, "missing").when(F.size("ambiguities") > 0, "ambiguous").otherwise("ok")
    return rows.select("request", status.alias("status"), "analysis_type", "mode", F.when(F.col("known"), F.col("produces")).alias("produces"), *CONTRACT, "missing", "ambiguities", "log", *(f"{d}_candidates" for d in ("interval", "site", "group", "value")))
