"""States of hooks, panels, plans, products, estimands and questions, each rolled up from what stands below it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.operators.graph import BLOCKED, COMPLETE, FAILED, MISSING, READY, RESOLVED, UNKNOWN, roll_up
from gridtally.session import checkpointed

DONE, LOST = (RESOLVED, COMPLETE), (MISSING, BLOCKED, UNKNOWN, FAILED)


def _any(c: Column) -> Column:
    return F.coalesce(F.bool_or(c), F.lit(False))


def _of_layers(hooks: DataFrame, layers: DataFrame) -> DataFrame:
    """hooks (hook, layer, required) with each layer's state; one that no table has is UNKNOWN_CONTRACT."""
    return hooks.filter("layer is not null").join(layers.select("layer", "state"), "layer", "left").withColumn("state", F.coalesce("state", F.lit(UNKNOWN)))


def hook_states(asked: DataFrame, hooks: DataFrame, layers: DataFrame) -> DataFrame:
    """(hook, state) for each hook asked for: RESOLVED if all required layers are resolved or complete, or none is required;
    BLOCKED_BY_INPUT if one is missing, blocked, unknown or failed; else READY_TO_RUN. A hook that no table has is UNKNOWN_CONTRACT.

    hooks is (hook, layer, required); a row without a layer makes a hook known that has none.
    """
    agg = _of_layers(hooks.filter("required"), layers).groupBy("hook").agg(F.bool_and(F.col("state").isin(*DONE)).alias("ready"), F.bool_or(F.col("state").isin(*LOST)).alias("lost"))
    known = hooks.select("hook").distinct().withColumn("known", F.lit(True))
    out = asked.select("hook").distinct().join(known, "hook", "left").join(agg, "hook", "left")
    state = F.when(F.col("known").isNull(), UNKNOWN).when(F.coalesce("ready", F.lit(True)), RESOLVED).when(F.col("lost"), BLOCKED).otherwise(READY)
    return out.select("hook", state.alias("state"))


def panels(hooks: DataFrame, layers: DataFrame, producers: DataFrame) -> DataFrame:
    """(hook, layer, required, layer_state, panel_state, actions) for each layer of a hook.

    Done layers are VISIBLE_COMPLETE, ready ones READY_TO_RUN with an action for each producer (layer, analysis_id), stale and partial ones VISIBLE_PARTIAL;
    of the rest required ones are VISIBLE_BLOCKED, with an action to inspect the registry, and optional ones HIDDEN_OPTIONAL.
    """
    s = F.col("state")
    panel = F.when(s.isin(*DONE), "VISIBLE_COMPLETE").when(s == READY, "READY_TO_RUN").when(s.isin("STALE", "PARTIAL"), "VISIBLE_PARTIAL").otherwise(F.when(F.col("required"), "VISIBLE_BLOCKED").otherwise("HIDDEN_OPTIONAL"))
    rows = _of_layers(hooks, layers).withColumn("panel_state", panel)
    runs = producers.groupBy("layer").agg(F.array_sort(F.collect_set("analysis_id")).alias("runs"))  # a layer has few producers
    action = lambda what, label, target: F.struct(F.lit(what).alias("action"), label.alias("label"), target.cast("string").alias("target"))
    none = F.array().cast("array<struct<action:string,label:string,target:string>>")
    run = F.transform(F.coalesce("runs", F.array().cast("array<string>")), lambda a: action("run", F.concat(F.lit("Run "), a), a))
    inspect = F.array(action("edit_registry", F.concat(F.lit("Inspect "), F.col("layer").cast("string"), F.lit(" in the layer registry")), F.col("layer")))
    actions = F.when(F.col("panel_state") == "READY_TO_RUN", run).when(F.col("panel_state") == "VISIBLE_BLOCKED", inspect).otherwise(none)
    return rows.join(runs, "layer", "left").select("hook", "layer", "required", F.col("state").alias("layer_state"), "panel_state", actions.alias("actions"))


def composed(asked: DataFrame, shown: DataFrame) -> DataFrame:
    """(hook, state) of the page that panels make: HIDDEN without a required one (or for a hook that isn't known), COMPLETE, READY_TO_RUN or BLOCKED if
    all required ones are, else PARTIAL. Panels blocked by unknown contracts alone are BLOCKED, as that rule comes first."""
    all_ = lambda state: F.bool_and(F.col("panel_state") == state)
    agg = shown.filter("required").groupBy("hook").agg(all_("VISIBLE_COMPLETE").alias("complete"), all_("READY_TO_RUN").alias("ready"), all_("VISIBLE_BLOCKED").alias("blocked"))
    state = F.when(F.col("complete").isNull(), "HIDDEN").when(F.col("complete"), "COMPLETE").when(F.col("ready"), "READY_TO_RUN").when(F.col("blocked"), "BLOCKED").otherwise("PARTIAL")
    return asked.select("hook").distinct().join(agg, "hook", "left").select("hook", state.alias("state"))


def planned_hooks(hooks: DataFrame, layers: DataFrame) -> DataFrame:
    """(hook, state): the planner's roll-up of a hook's required layers."""
    members = _of_layers(hooks.filter("required"), layers).select(F.col("hook").alias("parent"), "state")
    return roll_up(hooks.select(F.col("hook").alias("parent")), members).select(F.col("parent").alias("hook"), "state")


def plan(requests: DataFrame, hooks: DataFrame, layers: DataFrame, name: str = "page") -> DataFrame:
    """(name, state) for requests (name, hook), of pages or of packages: the same roll-up over the hooks' states.

    A blocked or an unknown hook is none of the states that count as stuck, so a page of those alone is PARTIAL; without a hook it is HIDDEN.
    """
    own = requests.filter("hook is not null").select(name, "hook").distinct().join(planned_hooks(hooks, layers), "hook", "left")
    members = own.select(F.col(name).alias("parent"), F.coalesce("state", F.lit("UNKNOWN")).alias("state"))
    return roll_up(requests.select(F.col(name).alias("parent")), members).select(F.col("parent").alias(name), "state")


def product_states(products: DataFrame, backing: DataFrame, layers: DataFrame, depends: DataFrame) -> DataFrame:
    """(product, state) from (product, confidence), (product, layer), (layer, state) and (product, needs).

    Layers decide first: none declared or an unknown one: missing; one failed: blocked; one missing or blocked: missing; all resolved or
    complete: available; else missing. Confidence turns an available product to ready (review_passed), validated (preliminary) or
    blocked (rejected). Then what it depends on: a product that is missing, blocked, deprecated or not in the table blocks whatever its own state; a
    stale one makes a usable product stale. A product on a cycle, or above one, is blocked. products may have a column `declared`,
    a state (stale, deprecated) that stands in place of the first two steps.
    A round settles what depends on settled products alone, and carries only edges that are left.
    """
    of = backing.filter("layer is not null").join(layers.select("layer", "state"), "layer", "left").withColumn("state", F.coalesce("state", F.lit(UNKNOWN)))
    s = F.col("state")
    rolled = of.groupBy("product").agg(F.bool_or(s == UNKNOWN).alias("unknown"), F.bool_or(s == FAILED).alias("failed"), F.bool_and(s.isin(*DONE)).alias("done"))
    base = F.when(F.col("unknown").isNull() | F.col("unknown"), "missing").when(F.col("failed"), "blocked").when(F.col("done"), "available").otherwise("missing")
    sure = F.col("confidence")
    own = F.when((base == "available") & (sure == "review_passed"), "ready").when((base == "available") & (sure == "preliminary"), "validated").when((base == "available") & (sure == "rejected"), "blocked").otherwise(base)
    if "declared" in products.columns:
        own = F.coalesce("declared", own)
    open_ = checkpointed(products.join(rolled, "product", "left").select("product", own.alias("own")))
    edges = depends.filter("needs is not null").select("product", "needs").distinct().join(open_.select("product"), "product", "left_semi")
    known = open_.select(F.col("product").alias("needs"), F.lit(True).alias("known"))
    edges = edges.join(known, "needs", "left")
    marks = checkpointed(edges.filter("known is null").select("product", F.lit(True).alias("bad")).distinct())  # of what is settled below an open product
    edges = checkpointed(edges.filter("known").select("product", "needs"))
    settled = []
    while True:
        ready = open_.join(edges.select("product").distinct(), "product", "left_anti")
        below = marks.groupBy("product").agg(F.bool_or("bad").alias("bad"))
        state = F.when(F.col("bad"), "blocked").when(~F.col("bad") & F.col("own").isin("ready", "validated", "available"), "stale").otherwise(F.col("own"))
        new = checkpointed(ready.join(below, "product", "left").select("product", state.alias("state")))
        if new.isEmpty():
            break
        settled.append(new)
        told = new.filter("state in ('missing', 'blocked', 'deprecated', 'stale')").select(F.col("product").alias("needs"), (F.col("state") != "stale").alias("bad"))
        open_ = checkpointed(open_.join(new, "product", "left_anti"))
        marks = checkpointed(marks.join(open_, "product", "left_semi").union(edges.join(told, "needs").select("product", "bad").distinct()))
        edges = checkpointed(edges.join(new.select(F.col("product").alias("needs")), "needs", "left_anti").select("product", "needs"))
    out = open_.select("product", F.lit("blocked").alias("state"))  # on a cycle or above one
    for part in settled:
        out = out.unionByName(part)
    return out


def estimands(asked: DataFrame, preconditions: DataFrame, products: DataFrame, layers: DataFrame, attributes: DataFrame) -> DataFrame:
    """(estimand, state) for each estimand asked for, a row without any precondition being estimable.

    preconditions is (estimand, kind, id, required), a null kind making an estimand known that has none. Met are products that are ready, validated or available,
    layers resolved or complete, sample attributes known or covered; any other kind never is. All met: estimable; only optional ones unmet:
    partially_estimable; an unmet required attribute: needs_extra_data; else, and for estimands no table has, not_estimable.
    """
    met = lambda rows, kind, key, column, *good: rows.filter(F.col(column).isin(*good)).select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
    ok = met(products, "product", "product", "state", "ready", "validated", "available").union(met(layers, "layer", "layer", "state", *DONE)).union(met(attributes, "sample_attribute", "attribute", "status", "known", "covered"))
    # rows without a kind or an id meet nothing, and as equal keys they would all meet in one task
    named = F.col("kind").isNotNull() & F.col("id").isNotNull()
    seen = preconditions.filter(named).join(ok.distinct().withColumn("met", F.lit(True)), ["kind", "id"], "left")
    seen = seen.unionByName(preconditions.filter(~named).withColumn("met", F.lit(None).cast("boolean")))
    unmet = F.col("met").isNull() & F.col("kind").isNotNull()
    required = F.coalesce("required", F.lit(True))
    agg = seen.groupBy("estimand").agg(_any(unmet & required).alias("missing"), _any(unmet & ~required).alias("soft"), _any(unmet & required & (F.col("kind") == "sample_attribute")).alias("extra"))
    state = F.when(F.col("missing").isNull(), "not_estimable").when(~F.col("missing") & ~F.col("soft"), "estimable").when(~F.col("missing"), "partially_estimable").when(F.col("extra"), "needs_extra_data").otherwise("not_estimable")
    return asked.select("estimand").distinct().join(agg, "estimand", "left").select("estimand", state.alias("state"))


def question_estimability(questions: DataFrame, of: DataFrame, states: DataFrame) -> DataFrame:
    """(question, state) from (question), (question, estimand) and (estimand, state): fully_estimable if all are, partially_estimable if some are only in part,
    needs_extra_data if one does, else limited; unknown without estimands."""
    s = F.coalesce("state", F.lit("not_estimable"))
    agg = of.join(states, "estimand", "left").groupBy("question").agg(F.bool_and(s == "estimable").alias("fully"), F.bool_and(s.isin("estimable", "partially_estimable")).alias("partly"), F.bool_or(s == "needs_extra_data").alias("extra"))
    state = F.when(F.col("fully").isNull(), "unknown").when(F.col("fully"), "fully_estimable").when(F.col("partly"), "partially_estimable").when(F.col("extra"), "needs_extra_data").otherwise("limited")
    return questions.select("question").distinct().join(agg, "question", "left").select("question", state.alias("state"))
