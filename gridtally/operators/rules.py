"""Rule tables over evidence: segments, gates, tiers, bands, completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtally.operators import ranges


def frequency_band(freq: Column) -> Column:
    """rare, low, intermediate, high or nearly_fixed; each band holds its lower bound."""
    return F.when(freq < 0.05, "rare").when(freq < 0.15, "low").when(freq < 0.5, "intermediate").when(freq < 0.85, "high").otherwise("nearly_fixed")


def recombinant_gate(segments: DataFrame, key: str, width: int, least_fraction: float = 0.15, least_bp: int = 50_000) -> DataFrame:
    """Per key of segments (key, segment, state, n windows): dominant state, share outside it, longest stretch outside, gate.

    The dominant state has most windows, the lesser name on a tie. The gate fires with enough of a share
    outside and a long enough stretch of it; width is a window's length.
    """
    totals = segments.groupBy(key, "state").agg(F.sum("n").alias("w"))
    top = totals.groupBy(key).agg(F.min_by("state", F.struct(-F.col("w"), F.col("state"))).alias("dominant"), F.sum("w").alias("total"), F.max("w").alias("most"))
    away = segments.join(top.select(key, "dominant"), key).filter("state <> dominant").groupBy(key).agg((F.max("n") * width).alias("longest_bp"))
    out = top.join(away, key, "left").select(key, "dominant", (1 - F.col("most") / F.col("total")).alias("deviation"), F.coalesce("longest_bp", F.lit(0)).alias("longest_bp"))
    return out.withColumn("fires", (F.col("deviation") >= least_fraction) & (F.col("longest_bp") >= least_bp))


def recombinant_call(regime: Column, phase: Column, resolved: Column) -> Column:
    """(call, confidence) of the regime gate and the phase signal; resolved says whether the phase could have told."""
    call = F.when(regime & phase, F.struct(F.lit("RECOMBINANT").alias("call"), F.lit("HIGH").alias("confidence"))).when(regime & ~resolved, F.struct(F.lit("RECOMBINANT").alias("call"), F.lit("MEDIUM").alias("confidence")))
    none = F.lit(None).cast("string").alias("confidence")
    return call.when(regime, F.struct(F.lit("recomb_disputed").alias("call"), none)).when(phase, F.struct(F.lit("recomb_ghsl_only").alias("call"), none))


def separation_flag(silhouette: Column) -> Column:
    """clean from 0.40 on, else noisy; null without a silhouette."""
    return F.when(silhouette >= 0.40, "clean").when(silhouette < 0.40, "noisy")


def silhouettes(rows: DataFrame, by: str, value: str, cluster: str, labels: list[str]) -> DataFrame:
    """(by, n, silhouette, flag): the mean silhouette, to 4 digits, of a value in clusters of the given labels.

    On one axis the distances to a cluster's members follow from counts and sums below a value, so a row looks at one window a label and
    never at the other rows. A row that is alone in its cluster counts 0; without a second cluster there is none.
    """
    whole = Window.partitionBy(by)
    upto = whole.orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    x, own, far = F.col(value).cast("double"), None, []
    for label in labels:
        one, v = (F.col(cluster) == label).cast("long"), F.when(F.col(cluster) == label, F.col(value).cast("decimal(28,9)"))
        n, low_n = F.sum(one).over(whole), F.sum(one).over(upto)
        total, low = (F.coalesce(F.sum(v).over(w), F.lit(0)).cast("double") for w in (whole, upto))
        distance = x * low_n - low + (total - low) - x * (n - low_n)
        within = F.when(F.col(cluster) == label, F.when(n > 1, distance / (n - 1)))
        own = within if own is None else F.coalesce(own, within)
        far.append(F.when((F.col(cluster) != label) & (n > 0), distance / n))
    parts = rows.filter(F.col(cluster).isin(labels)).withColumn("_a", own).withColumn("_b", F.least(*far) if len(far) > 1 else far[0])
    score = F.when(F.col("_b").isNull(), None).when(F.col("_a").isNull() | (F.greatest("_a", "_b") == 0), 0.0).otherwise((F.col("_b") - F.col("_a")) / F.greatest("_a", "_b"))
    out = parts.withColumn("_s", score).groupBy(by).agg(F.count("*").alias("n"), F.round(F.sum(F.col("_s").cast("decimal(38,12)")).cast("double") / F.count("_s"), 4).alias("silhouette"))
    return out.withColumn("flag", separation_flag(F.col("silhouette")))


def robustness(aris: DataFrame, by: str) -> DataFrame:
    """(by, min_ari, mean_ari, verdict, disagreeing) of pairs (by, pair, ari): robust with all of 0.9 or more, partial from 0.5 on, else ambiguous."""
    out = aris.groupBy(by).agg(F.min("ari").alias("min_ari"), (F.sum(F.col("ari").cast("decimal(38,12)")).cast("double") / F.count("ari")).alias("mean_ari"), F.array_sort(F.collect_list(F.when(F.col("ari") < 0.9, F.col("pair")))).alias("disagreeing"))
    verdict = F.when(F.col("min_ari") >= 0.9, "robust").when(F.col("min_ari") >= 0.5, "partial").when(F.col("min_ari").isNotNull(), "ambiguous")
    return out.select(by, "min_ari", "mean_ari", verdict.alias("verdict"), "disagreeing")


def class_allowed(q4: Column, q5: Column, named: Column) -> Column:
    """The evolutionary class, given only with 30 percent of both the fourth and the fifth question, else unresolved."""
    return F.when((q4 >= 30) & (q5 >= 30), F.coalesce(named, F.lit("unresolved"))).otherwise("unresolved")


def step_status(has_result: Column, missing: Column, ambiguous: Column) -> Column:
    """What a step can do: RESULT_READY, MISSING, BLOCKED by what is ambiguous, or RUN_READY."""
    return F.when(has_result, "RESULT_READY").when(missing > 0, "MISSING").when(ambiguous > 0, "BLOCKED").otherwise("RUN_READY")


def dropout_share(depth: float, most_reads: int) -> float:
    """The share of carriers with at most so many reads, of Poisson counts of a mean depth."""
    from math import exp, factorial

    return sum(exp(-depth) * depth**k / factorial(k) for k in range(most_reads + 1))


def manifest_problems(rows: DataFrame) -> Column:
    """What is wrong with an action's manifest (action_id, type, dataset_id, runner): fields that are missing, then those of a wrong form."""
    forms = {"action_id": "^act_[A-Za-z0-9_]+$", "type": "^[a-z][a-z0-9_]*$", "dataset_id": "^[a-z][a-z0-9_]*$", "runner": "(?s)^.+$"}
    absent = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in forms]
    wrong = [F.when(~F.col(c).rlike(form), F.lit(f"invalid {c}")) for c, form in forms.items()]
    return F.array_compact(F.array(*absent, *wrong))


def envelope_problems() -> Column:
    """What is wrong with a layer's envelope: fields that are missing, then those of a wrong form or value."""
    fields = ("layer_id", "layer_type", "schema_version", "stage", "dataset_id", "status", "created_at")
    absent = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in fields]
    wrong = [("layer_id", ~F.col("layer_id").rlike("^[A-Za-z0-9_]+$")), ("layer_type", ~F.col("layer_type").rlike("^[a-z][a-z0-9_]*$")), ("stage", ~F.col("stage").isin("staging", "normalized")), ("status", ~F.col("status").isin("review", "active", "deprecated", "stale", "superseded"))]
    return F.array_compact(F.array(*absent, *(F.when(bad, F.lit(f"invalid {c}")) for c, bad in wrong)))


def atlas_of(asked: Column, manifest: Column, active: Column) -> Column:
    """The atlas asked for, else the manifest's, else the active one; null where that is no atlas's name."""
    some = lambda c: F.nullif(c, F.lit(""))
    found = F.coalesce(some(asked), some(manifest), some(active))
    return F.when(found.rlike("^[a-z][a-z0-9_]*$"), found)


def event_class(longest_bp: Column, tracts: Column) -> Column:
    return F.when(longest_bp >= 200_000, "double_crossover").when(tracts > 0, "gene_conversion_embedded").otherwise("single_crossover_or_ambiguous")


def label_stats(rows: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """Per key: labels, switches in order, distinct labels, and the entropy of the labels in nats."""
    dealt = ranges.with_previous(ranges.ranged(rows, [key], order), [key], order, F.col(label), "_before")
    switched = dealt.withColumn("_s", (F.col("_before.v").isNotNull() & (F.col("_before.v") != F.col(label))).cast("int"))
    counts = switched.groupBy(key, label).agg(F.count("*").alias("n"), F.sum("_s").alias("s"))
    total = counts.groupBy(key).agg(F.sum("n").cast("long").alias("n"), F.sum("s").cast("long").alias("switches"), F.count("*").alias("n_labels"), F.sum((F.col("n") * F.ln("n")).cast("decimal(38,9)")).cast("double").alias("nln"))
    return total.select(key, "n", "switches", "n_labels", (F.ln("n") - F.col("nln") / F.col("n")).alias("entropy"))


def completion(evidence: DataFrame) -> DataFrame:
    """Per candidate and question (the key's first two letters): resolved over all but the not applicable, in percent."""
    question = F.substring("key", 1, 2)
    value = F.coalesce("value", F.lit(""))
    rows = evidence.groupBy("candidate_id", question.alias("question")).agg(F.count("*").alias("total"), F.sum((value == "not_applicable").cast("int")).alias("na"), F.sum((~value.isin("", "not_applicable")).cast("int")).alias("resolved"))
    return rows.select("candidate_id", "question", F.col("total"), F.col("resolved").cast("long").alias("resolved"), F.when(F.col("total") > F.col("na"), F.col("resolved") * 100.0 / (F.col("total") - F.col("na"))).alias("percent"))


def confidence_tier(a: Column, b: Column, c: Column, d: Column, c_tested: Column, d_tested: Column, callers: Column, dimensions: Column) -> Column:
    """The tier by the pathway of passed layers: a to d passed, c and d tested, callers that see layer B, positive dimensions of D.

    Only B: SV-1 with two callers, else SV-2. Tier 1: all four, or A, B and D with C untested. Tier 2: A and C without B and D untested,
    or A and B with D tested in vain or C untested. Tier 3: any of A, B, C and four dimensions. Else tier 4.
    """
    convergent = F.when(a & b & c & d, "1").when(a & b & d & ~c_tested, "1")
    partial = convergent.when(a & c & ~b & ~d_tested, "2").when(a & b & ((d_tested & ~d) | ~c_tested), "2")
    tier = partial.when((a | b | c) & (dimensions >= 4), "3").otherwise("4")
    only_b = b & ~a & ~c
    return F.when(only_b & (callers >= 2), "SV-1").when(only_b, "SV-2").otherwise(tier)


def thirds(rows: DataFrame, by: str, value: str, tie: str) -> DataFrame:
    """Adds the third (1 to 3) of each row in its group and its percent rank."""
    placed = ranges.with_place(ranges.ranged(rows, [by], [value, tie]), [by], [value, tie], "_place", "_of")
    # the rank of equal values is the place of their first; they may lie in several ranges
    firsts = placed.groupBy(F.col(by).alias("_by"), F.col(value).alias("_value")).agg(F.min("_place").alias("_first"))
    joined = placed.join(firsts, F.col(by).eqNullSafe(F.col("_by")) & F.col(value).eqNullSafe(F.col("_value")))
    share = F.when(F.col("_of") > 1, (F.col("_first") - 1) / (F.col("_of") - 1)).otherwise(0.0)
    return joined.select(*rows.columns, ranges.tile(F.col("_place"), F.col("_of"), 3).alias("third"), share.alias("rank_share"))


def stale(stored: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Rows of stored whose version isn't the current one of their key; a key that is gone is stale too."""
    now = current.select(key, F.col("version").alias("current_version"))
    return stored.join(now, key, "left").filter(~F.col("version").eqNullSafe(F.col("current_version")))


def characterised(evidence: DataFrame, table: DataFrame) -> DataFrame:
    """(candidate_id, question, state) of evidence (candidate_id, key, value) under a rule table (question, key, op, bound, weight).

    A rule with op 'ge' or 'lt' compares numbers, 'eq' texts. Nothing measured: EMPTY; supporting and contradicting
    rules (of weight 1 and -1) both met: CONTRADICTED; all supporting rules met: ANSWERED; some: PARTIAL; none: MEASURED.
    """
    joined = table.join(evidence, "key", "left")
    number, bound = F.col("value").try_cast("double"), F.col("bound").try_cast("double")
    met = F.when(F.col("op") == "ge", number >= bound).when(F.col("op") == "lt", number < bound).otherwise(F.col("value") == F.col("bound"))
    rows = joined.withColumn("met", F.coalesce(met, F.lit(False))).filter("candidate_id is not null and coalesce(value, '') <> ''")
    rules = table.filter("weight > 0").groupBy("question").agg(F.count("*").alias("wanted"))
    agg = rows.groupBy("candidate_id", "question").agg(F.sum((F.col("met") & (F.col("weight") > 0)).cast("int")).alias("pro"), F.sum((F.col("met") & (F.col("weight") < 0)).cast("int")).alias("con"))
    grid = evidence.select("candidate_id").distinct().withColumn("_one", F.lit(1)).join(F.broadcast(rules.withColumn("_one", F.lit(1))), "_one").drop("_one")
    out = grid.join(agg, ["candidate_id", "question"], "left")
    state = F.when(F.col("pro").isNull(), "EMPTY").when((F.col("pro") > 0) & (F.col("con") > 0), "CONTRADICTED").when(F.col("pro") >= F.col("wanted"), "ANSWERED").when(F.col("pro") > 0, "PARTIAL").otherwise("MEASURED")
    return out.select("candidate_id", "question", state.alias("state"))


def version_gate(rank: Column, least: str) -> Column:
    """Whether a group's validation reaches a level: NONE < UNCERTAIN < SUPPORTED < VALIDATED; SUSPECT never does."""
    order = F.create_map(*(F.lit(x) for pair in (("NONE", 0), ("UNCERTAIN", 1), ("SUPPORTED", 2), ("VALIDATED", 3)) for x in pair))
    return F.coalesce(order[rank] >= order[F.lit(least)], F.lit(False))


def composite_flag(patterns: DataFrame, by: str) -> DataFrame:
    """clean with 80 percent homogeneous samples, likely with over 20 percent of two or more blocks, maybe from 5 percent on."""
    share = lambda *names: F.sum(F.col("pattern").isin(*names).cast("int")) / F.count("*")
    agg = patterns.groupBy(by).agg(share("homogeneous").alias("h"), share("two_block", "multi_block").alias("b"))
    return agg.select(by, F.when(F.col("h") >= 0.8, "clean").when(F.col("b") > 0.2, "likely").when(F.col("b") >= 0.05, "maybe").otherwise("unclear").alias("flag"))
