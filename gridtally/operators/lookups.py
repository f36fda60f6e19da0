"""Results, modules, labels and definitions looked up in registries by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.functions.scalars import interval_label, iso_utc

#: Fixed by the registry: what a contract and its result agree in, and the beginnings of a chromosome's name.
CONTRACT = ("analysis_type", "sample_set_id", "interval_set_id", "site_set_id")
CHROMOSOMES = ("LG", "chr", "C_")
#: Fixed by the registry: text fields of a module and where they stand in its document.
MODULE_TEXT = {"module_name": "name", "version": "version", "family": "family", "biomod_status": "status", "stale_reason": "stale_reason", "parent": "parent", "last_run_id": "last_run.run_id", "last_run_status": "last_run.status", "last_run_qc": "last_run.qc_status", "last_run_seconds": "last_run.runtime_seconds", "n_samples": "last_run.n_samples"}


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def find_results(contracts: DataFrame, results: DataFrame, order: str = "place") -> DataFrame:
    """contracts and result_id: the first result, by order, that a contract describes, null where there is none.

    Both agree in CONTRACT, null being '', and in input_value_id, or in an input_result_id that isn't empty. Either way is an equi-join with the
    first result of each key, so neither an OR nor repeated results multiply rows.
    """
    out = contracts
    for by in ("input_value_id", "input_result_id"):
        keys = [*CONTRACT, by]
        named = results if by == "input_value_id" else results.filter(_text(by) != "")
        first = named.groupBy(*(_text(k).alias(f"_{k}") for k in keys)).agg(F.min(F.struct(order, "result_id")).alias(f"_by_{by}"))
        same = [_text(k) == F.col(f"_{k}") for k in keys]
        condition = same[0]
        for c in same[1:]:
            condition = condition & c
        out = out.join(first, condition, "left").drop(*(f"_{k}" for k in keys))
    found = F.least("_by_input_value_id", "_by_input_result_id")
    return out.withColumn("result_id", found["result_id"]).drop("_by_input_value_id", "_by_input_result_id")


def contract_state(result_id: Column, missing: Column, ambiguous: Column) -> Column:
    """The state of a resolved step: a result comes first, then what is missing, then what is ambiguous."""
    some = lambda x: F.coalesce(F.size(x), F.lit(0)) > 0
    return F.when(result_id.isNotNull(), "RESULT_READY").when(some(missing), "MISSING").when(some(ambiguous), "BLOCKED").otherwise("RUN_READY")


def unwired_consumers(results: DataFrame, produces: DataFrame, consumers: DataFrame) -> DataFrame:
    """(result_id, consumer): consumers (tag, consumer as type/mode) of the tag that a result's analysis_type produces, but for those of a type that has a result with this input."""
    made = results.select("result_id", "analysis_type").join(produces.select("analysis_type", "tag"), "analysis_type").join(consumers.select("tag", "consumer").distinct(), "tag")
    wired = results.filter(_text("input_result_id") != "").select(F.col("input_result_id").alias("result_id"), F.col("analysis_type").alias("_type")).distinct()
    offered = made.select("result_id", "consumer", F.substring_index("consumer", "/", 1).alias("_type"))
    return offered.join(wired, ["result_id", "_type"], "left_anti").select("result_id", "consumer")


def module_states(modes: DataFrame, modules: DataFrame) -> DataFrame:
    """modes with state and label of their module_name, by the first rule that holds; flags are the texts 'true' and 'false'."""
    fields = ("version", "installed", "last_run_status", "stale", "stale_reason", "ready", "last_run_qc")
    known = modules.select(F.col("module_name").alias("_name"), F.struct(*fields).alias("_m"))
    joined = modes.join(known, F.trim(_text("module_name")) == F.col("_name"), "left")
    name, m = F.trim(_text("module_name")), F.col("_m")
    text = lambda f, otherwise="": F.coalesce(F.nullif(m[f], F.lit("")), F.lit(otherwise))
    titled = F.concat(name, F.lit(" "), text("version"))
    rules = [
        (name == "", "MOD_CONCEPTUAL", F.lit("(no module_name set)")),
        (m.isNull(), "MOD_CONCEPTUAL", F.concat(name, F.lit(" (not in module_registry)"))),
        (text("installed") != "true", "MOD_NOT_INSTALLED", titled),
        (text("last_run_status") == "failed", "MOD_FAILED", F.concat(titled, F.lit(" — last run failed"))),
        (text("stale") == "true", "MOD_STALE", F.concat(name, F.lit(" — stale: "), text("stale_reason", "inputs changed"))),
        (text("ready") == "true", "MOD_READY", F.concat(titled, F.lit(" — last QC: "), text("last_run_qc", "?"))),
    ]
    state, label = F, F
    for condition, named, shown in rules:
        state, label = state.when(condition, named), label.when(condition, shown)
    return joined.withColumns({"state": state.otherwise("MOD_AVAILABLE"), "label": label.otherwise(titled)}).drop("_name", "_m")


def flattened_modules(documents: DataFrame, column: str = "document") -> DataFrame:
    """One row of texts for each JSON document of a module; what is absent is '', but a module without 'installed' is installed."""
    v = F.try_parse_json(column)
    text = lambda path: F.coalesce(F.try_variant_get(v, f"$.{path}", "string"), F.lit(""))

    def flag(path: str) -> Column:
        lowered = F.lower(text(path))
        return F.when(lowered.isin("true", "false"), lowered).otherwise("")

    started = F.try_variant_get(v, "$.last_run.started_at", "variant")
    epoch = F.when(F.schema_of_variant(started).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(started, "$", "double").cast("long"))
    absent = F.try_variant_get(v, "$.installed", "variant").isNull()
    columns = {n: text(path) for n, path in MODULE_TEXT.items()}
    columns |= {"installed": F.when(absent, "true").otherwise(flag("installed")), "ready": flag("ready"), "stale": flag("stale")}
    columns |= {"last_run_started": F.coalesce(iso_utc(epoch), text("last_run.started_at"))}
    columns |= {"derivatives": F.coalesce(F.array_join(F.try_variant_get(v, "$.derivatives", "array<string>"), ","), F.lit(""))}
    return documents.filter(v.isNotNull()).select(*(c.alias(n) for n, c in columns.items()))


def set_needs_definition(op: Column, parents: Column) -> Column:
    """Whether a set's derivation is more than a row of a table can say."""
    return F.coalesce(F.size(parents) > 1, F.lit(False)) | F.coalesce(op == "filter", F.lit(False))


def single_parent(parent: Column, op: Column, parents: Column) -> Column:
    """The parent that is named, or the only one of a set made from a set or a group, else ''."""
    only = F.when((F.size(parents) == 1) & op.isin("from_set", "from_group"), F.get(parents, 0))
    return F.coalesce(F.nullif(parent, F.lit("")), only, F.lit(""))


def analysis_needs_definition(cardinalities: Column, artifacts: Column, products: Column) -> Column:
    """Whether an analysis has several inputs or products, or an input set that isn't one (null counts as one)."""
    several = lambda x: F.coalesce(F.size(x) > 1, F.lit(False))
    return several(cardinalities) | several(artifacts) | several(products) | F.coalesce(F.exists(cardinalities, lambda c: F.coalesce(c != "one", F.lit(False))), F.lit(False))


def labelled_results(results: DataFrame, envelopes: DataFrame) -> DataFrame:
    """(result_id, label) of results (result_id, chrom, start, end, artifacts): their own interval, or else that of the first artifact whose envelope
    (artifact_id, chrom, start, end) has one, or else the first part of an artifact's id that reads like a chromosome; '—' without artifacts.
    """
    named = lambda c: F.coalesce(c, F.lit("")) != ""
    own = F.when(named(F.col("chrom")), interval_label(F.col("chrom"), F.col("start"), F.col("end")))
    rows = results.select("result_id", own.alias("own"), F.coalesce("artifacts", F.array().cast("array<string>")).alias("artifacts"))
    wanted = rows.filter("own is null").select("result_id", F.posexplode("artifacts").alias("at", "artifact_id"))
    told = envelopes.filter(named(F.col("chrom"))).select("artifact_id", interval_label(F.col("chrom"), F.col("start"), F.col("end")).alias("told"))
    first = wanted.join(told, "artifact_id").groupBy("result_id").agg(F.min_by("told", "at").alias("told"))
    parts = F.flatten(F.transform("artifacts", lambda a: F.split(a, "_")))
    like = F.filter(parts, lambda t: F.rlike(t, F.lit("^(" + "|".join(CHROMOSOMES) + ")")) & F.rlike(t, F.lit(r"\d")))
    guess = F.when(F.size("artifacts") == 0, "—").otherwise(F.coalesce(F.get(like, 0), F.lit("whole-genome")))
    return rows.join(first, "result_id", "left").select("result_id", F.coalesce("own", "told", guess).alias("label"))
