"""Catalogue joins, reference checks, facets, search and lineage over registry tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtally.operators.sets import csv_items


def enriched(facts: DataFrame, dims: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """facts left-joined with each (dimension, its key, the fact's key); Spark broadcasts those that its statistics show small."""
    for dim, key, fk in dims:
        facts = facts.join(dim, facts[fk] == dim[key], "left").drop(dim[key]) if key != fk else facts.join(dim, key, "left")
    return facts


def last_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that comes last; rows with an empty key drop out."""
    others = [c for c in rows.columns if c != key]
    kept = rows.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    return kept.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_x")).select(key, *(F.col(f"_x.{c}").alias(c) for c in others))


def missing_references(facts: DataFrame, row_id: str, references: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """(row_id, column, value) for each reference that names nothing; null and empty values are optional."""
    parts = []
    for column, table, key in references:
        value = F.col(column).cast("string")
        used = facts.filter(value.isNotNull() & (value != "")).select(F.col(row_id).alias("row_id"), F.lit(column).alias("column"), value.alias("value"))
        parts.append(used.join(table.select(F.col(key).cast("string").alias("value")), "value", "left_anti").select("row_id", "column", "value"))
    return reduce(DataFrame.unionByName, parts)


def membership_gaps(group: DataFrame, whole: DataFrame, member: str) -> DataFrame:
    """(member, kind): in the group but not in the set ('unknown'), or in the set but in no group ('ungrouped')."""
    unknown = group.select(member).distinct().join(whole.select(member), member, "left_anti").withColumn("kind", F.lit("unknown"))
    return unknown.unionByName(whole.select(member).distinct().join(group.select(member), member, "left_anti").withColumn("kind", F.lit("ungrouped")))


def ordered_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Places where two lists (idx, value) differ, one of them maybe ended."""
    both = left.select("idx", F.col("value").alias("left_value")).join(right.select("idx", F.col("value").alias("right_value")), "idx", "full_outer")
    return both.filter(~F.col("left_value").eqNullSafe(F.col("right_value")))


def check_report(checks: list[tuple[str, DataFrame, Column]], shown: int = 5) -> DataFrame:
    """(check, pass, n_violations, details) from (name, violations, their text); details are the first few in order."""
    rows = []
    for name, found, text in checks:
        texts = found.select(text.cast("string").alias("t"))
        top = texts.orderBy("t").limit(shown).agg(F.array_sort(F.collect_list("t")).alias("d"))
        rows.append(texts.agg(F.count("*").alias("n")).join(top).select(F.lit(name).alias("check"), (F.col("n") == 0).alias("pass"), F.col("n").alias("n_violations"), F.array_join("d", "; ").alias("details")))
    return reduce(DataFrame.unionByName, rows)


def integrity_checks(results: DataFrame, groups: DataFrame, candidates: DataFrame, evidence: DataFrame, files: DataFrame) -> DataFrame:
    """The seven checks of a registry, as check_report gives them.

    results (result_id, group_id, group_version, candidate_id, file, sha256), groups (group_id, created), candidates (candidate_id),
    evidence (evidence_id, candidate_id), files (path, sha256). A result of another version of its group is stale: it is
    listed, but the check passes. A result without a candidate or a digest is not checked for it.
    """
    rid = F.col("result_id")
    known = candidates.select("candidate_id").distinct()
    of_group = groups.select("group_id", "created")
    stored = files.select(F.col("path").alias("file"), F.col("sha256").alias("_found"))
    of = lambda left, label: F.concat_ws(" ", left.cast("string"), label.cast("string"))
    report = check_report([
        ("groups exist", results.join(of_group, "group_id", "left_anti"), of(rid, F.col("group_id"))),
        ("candidates exist", results.filter("candidate_id is not null").join(known, "candidate_id", "left_anti"), of(rid, F.col("candidate_id"))),
        ("versions match", results.join(of_group, "group_id").filter(~F.col("group_version").eqNullSafe(F.col("created"))), of(rid, F.col("group_version"))),
        ("files exist", results.join(stored, "file", "left_anti"), of(rid, F.col("file"))),
        ("digests match", results.filter("sha256 is not null").join(stored, "file").filter(~F.col("sha256").eqNullSafe(F.col("_found"))), of(rid, F.col("file"))),
        ("no orphans", files.join(results.select(F.col("file").alias("path")), "path", "left_anti"), F.col("path")),
        ("evidence is registered", evidence.join(known, "candidate_id", "left_anti"), of(F.col("evidence_id"), F.col("candidate_id"))),
    ])
    return report.withColumn("pass", F.col("pass") | (F.col("check") == "versions match"))


def hierarchy_checks(species: DataFrame, genomes: DataFrame, chromosomes: DataFrame, cohorts: DataFrame, samples: DataFrame, groups: DataFrame, members: DataFrame, candidates: DataFrame, references: DataFrame, results: DataFrame) -> DataFrame:
    """The nine checks of the chain from species to results, as check_report gives them.

    species (species_id); genomes (genome_id, species_composition array); chromosomes (genome_id, chrom); cohorts (cohort_id, genome_id,
    species_composition and parent_cohort_ids arrays); samples (cohort_id, sample_id, species); groups (group_id, cohort_id,
    parent_group_id, created); members (group_id, sample_id); candidates (candidate_id, cohort_id, chrom); references (kind, id, cohort_id)
    of groups, candidates, results and evidence; results (result_id, group_id, group_version).
    """
    of = lambda *c: F.concat_ws(" ", *(F.col(x).cast("string") for x in c))
    set_of = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    used = genomes.select("genome_id", F.explode("species_composition").alias("species_id"))
    cohort = cohorts.select("cohort_id", "genome_id", set_of(F.col("species_composition")).alias("composition"))
    seen = samples.groupBy("cohort_id").agg(F.array_sort(F.collect_set("species")).alias("seen"))
    derived = cohorts.select("cohort_id", F.explode("parent_cohort_ids").alias("parent")).join(cohort, "cohort_id")
    parent = cohort.select(F.col("cohort_id").alias("parent"), F.col("genome_id").alias("_genome"), F.col("composition").alias("_composition"))
    sub = groups.filter("parent_group_id is not null")
    above = groups.select(F.col("group_id").alias("parent_group_id"), F.col("cohort_id").alias("_cohort"))
    held = members.join(groups.select("group_id", "cohort_id"), "group_id")
    placed = candidates.join(cohorts.select("cohort_id", "genome_id"), "cohort_id")
    who = groups.select("group_id", "created")
    return check_report([
        ("species of genomes", used.join(species, "species_id", "left_anti"), of("genome_id", "species_id")),
        ("genomes of cohorts", cohorts.join(genomes, "genome_id", "left_anti"), of("cohort_id", "genome_id")),
        ("cohorts of rows", references.join(cohorts, "cohort_id", "left_anti"), of("kind", "id", "cohort_id")),
        ("composition of cohorts", cohort.join(seen, "cohort_id", "left").filter(F.col("composition") != F.coalesce("seen", F.array().cast("array<string>"))), of("cohort_id")),
        ("parents of cohorts", derived.join(parent, "parent", "left").filter(~(F.col("genome_id").eqNullSafe(F.col("_genome")) & F.col("composition").eqNullSafe(F.col("_composition")))), of("cohort_id", "parent")),
        ("parents of groups", sub.join(above, "parent_group_id", "left").filter(~F.col("cohort_id").eqNullSafe(F.col("_cohort"))), of("group_id", "parent_group_id")),
        ("members of groups", held.join(samples.select("cohort_id", "sample_id"), ["cohort_id", "sample_id"], "left_anti"), of("group_id", "sample_id")),
        ("chromosomes of candidates", placed.join(chromosomes, ["genome_id", "chrom"], "left_anti"), of("candidate_id", "chrom")),
        ("groups of results", results.join(who, "group_id", "left").filter(~F.col("group_version").eqNullSafe(F.col("created"))), of("result_id", "group_id")),
    ])


def stray_subgroups(members: DataFrame) -> DataFrame:
    """(group_id, parent, member) of members (group_id, member) that a group named parent__part has and its parent has not."""
    parted = members.withColumn("parent", F.regexp_extract("group_id", r"^(.+?)__.+$", 1)).filter("parent <> ''")
    own = members.select(F.col("group_id").alias("parent"), "member").distinct()
    return parted.distinct().join(own, ["parent", "member"], "left_anti").select("group_id", "parent", "member")


def newest_first(rows: DataFrame, *ties: str) -> DataFrame:
    """Rows (created_at, analysis_id) in an inventory's order: the newest first, then analyses from the last name on, null being empty; then by ties."""
    key = lambda c: F.desc(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return rows.orderBy(key("created_at"), key("analysis_id"), *ties)


def search(rows: DataFrame, key: str, fields: list[str], query: str, top: int = 50) -> DataFrame:
    """Hits of a substring, whatever its case: key begins with it, holds it, or another field does; then by key."""
    q = query.lower()
    low = F.lower(F.col(key))
    hits = rows.filter(F.contains(F.lower(F.concat_ws(" ", key, *fields)), F.lit(q)))
    rank = F.when(F.startswith(low, F.lit(q)), 0).when(F.contains(low, F.lit(q)), 1).otherwise(2)
    return hits.withColumn("rank", rank).orderBy("rank", key).limit(top)


def tail(rows: DataFrame, order: str, n: int, filters: dict[str, str | None]) -> DataFrame:
    """The last n rows in order of those equal to every given filter, with the count of all rows as total."""
    total = rows.agg(F.count("*").alias("total"))
    kept = rows
    for column, value in filters.items():
        if value is not None:
            kept = kept.filter(F.col(column) == value)
    return kept.orderBy(F.desc(order)).limit(n).join(F.broadcast(total))


def with_prefix(rows: DataFrame, key: str, prefix: str, order: str, n: int) -> DataFrame:
    """The last n rows in order of those whose key begins with the prefix."""
    return rows.filter(F.startswith(F.col(key), F.lit(prefix))).orderBy(F.desc(order)).limit(n)


def lineage(modules: DataFrame) -> DataFrame:
    """(producer, consumer, tag) from (module, produces, requires), both comma lists; none feeds itself."""
    made = modules.select(F.col("module").alias("producer"), F.explode(csv_items(F.col("produces"))).alias("tag"))
    used = modules.select(F.col("module").alias("consumer"), F.explode(csv_items(F.col("requires"))).alias("tag"))
    return made.join(used, "tag").filter("producer <> consumer").select("producer", "consumer", "tag").distinct()


def unproduced(modules: DataFrame) -> DataFrame:
    """(consumer, tag) that no module makes."""
    used = modules.select(F.col("module").alias("consumer"), F.explode(csv_items(F.col("requires"))).alias("tag")).distinct()
    return used.join(modules.select(F.explode(csv_items(F.col("produces"))).alias("tag")), "tag", "left_anti").select("consumer", "tag")


def nearby(products: DataFrame, selected: DataFrame) -> DataFrame:
    """Products that share a sample scope or a coordinate scope with a selected one, and aren't selected."""
    by = lambda scope: products.join(selected.select(scope).distinct(), scope, "left_semi").select("product_id")
    return by("sample_scope").union(by("coordinate_scope")).distinct().join(selected.select("product_id"), "product_id", "left_anti")


def answerable(questions: DataFrame, selected: list[str]) -> DataFrame:
    """(question_id, matched) whose required list shares a product with the selection; matched is sorted."""
    chosen = F.array(*map(F.lit, selected))
    return questions.filter(F.arrays_overlap("requires", chosen)).select("question_id", F.array_sort(F.array_intersect("requires", chosen)).alias("matched"))


def fresh_versions(proposed: DataFrame, existing: DataFrame, most: int = 100) -> DataFrame:
    """(proposal, version_id): base_vN with the least free N from 1 on, given out in order; past most, base_v_TODO.

    The free numbers of a base are those of 1..n_existing+n_proposed that no id takes; the k-th proposal gets the k-th.
    """
    taken = existing.select(F.regexp_extract("id", r"^(.*)_v(\d+)$", 1).alias("base"), F.regexp_extract("id", r"^(.*)_v(\d+)$", 2).try_cast("int").alias("v")).filter("v is not null")
    wanted = proposed.withColumn("k", F.row_number().over(Window.partitionBy("base").orderBy("proposal")))
    span = wanted.groupBy("base").agg(F.max("k").alias("want")).join(taken.groupBy("base").agg(F.count("*").alias("have")), "base", "left").select("base", F.least(F.col("want") + F.coalesce("have", F.lit(0)), F.lit(most - 1)).cast("int").alias("upto"))
    free = span.select("base", F.explode(F.sequence(F.lit(1), F.col("upto"))).alias("v")).join(taken, ["base", "v"], "left_anti").withColumn("k", F.row_number().over(Window.partitionBy("base").orderBy("v")))
    return wanted.join(free, ["base", "k"], "left").select("proposal", F.concat("base", F.when(F.col("v").isNull(), F.lit("_v_TODO")).otherwise(F.concat(F.lit("_v"), F.col("v").cast("string")))).alias("version_id"))


def natural_order(name: Column, prefix: str = "LG") -> list[Column]:
    """Sort keys: names of the prefix and a number by number, all others behind in order of code points."""
    number = F.regexp_extract(name, rf"^{prefix}0*(\d+)$", 1).try_cast("long")
    return [number.isNull(), number, name]


def largest_per_key(files: DataFrame, pattern: str) -> DataFrame:
    """(key, path, bytes): for the key found in each path the largest file, the first path on a tie."""
    keyed = files.withColumn("key", F.regexp_extract("path", pattern, 0)).filter("key <> ''")
    return keyed.groupBy("key").agg(F.min_by(F.struct("path", "bytes"), F.struct(-F.col("bytes"), F.col("path"))).alias("x")).select("key", "x.path", "x.bytes")


def ownership(claims: DataFrame) -> DataFrame:
    """(key, owner, action) after claims (seq, key, owner, config, provisional, owned_by) in order of seq.

    A claim like the incumbent's merges and keeps the first owner; a provisional incumbent is succeeded; an
    incumbent that names the newcomer hands over; anything else is a conflict and changes nothing. Claims on
    one key are few, so they are folded in order.
    """
    item = F.struct("seq", "owner", "config", "provisional", "owned_by")
    listed = claims.groupBy("key").agg(F.array_sort(F.collect_list(item)).alias("c"))
    start = F.struct(F.element_at("c", 1)["owner"].alias("owner"), F.element_at("c", 1)["config"].alias("config"), F.element_at("c", 1)["provisional"].alias("provisional"), F.element_at("c", 1)["owned_by"].alias("owned_by"), F.lit("new").alias("action"))

    def fold(acc: Column, x: Column) -> Column:
        taken = lambda action: F.struct(x["owner"].alias("owner"), x["config"].alias("config"), x["provisional"].alias("provisional"), x["owned_by"].alias("owned_by"), F.lit(action).alias("action"))
        stays = lambda action: F.struct(acc["owner"].alias("owner"), acc["config"].alias("config"), acc["provisional"].alias("provisional"), acc["owned_by"].alias("owned_by"), F.lit(action).alias("action"))
        return F.when(x["config"] == acc["config"], stays("merge")).when(acc["provisional"], taken("succeed")).when(acc["owned_by"] == x["owner"], taken("transfer")).otherwise(stays("conflict"))

    final = listed.select("key", F.aggregate(F.slice("c", F.lit(2), F.size("c")), start, fold).alias("x"))
    return final.select("key", "x.owner", "x.action")
