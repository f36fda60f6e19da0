"""Dependency graphs: chains, closures, readiness states to a fixpoint."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtally.operators.sets import csv_items
from gridtally.session import checkpointed

#: States of a layer, as the registry names them: fixed values.
RESOLVED, COMPLETE, MISSING, READY, BLOCKED, FAILED, UNKNOWN = "RESOLVED", "COMPLETE", "KNOWN_MISSING", "READY_TO_RUN", "BLOCKED_BY_INPUT", "FAILED", "UNKNOWN_CONTRACT"

#: Rounds after which a growing union is written, so that its plan stays short.
UNIONS = 16
#: Levels of a closure that are written together.
LEVELS = 4


def _rounds(most: int | None):
    """1, 2, and so on without an end; raises beyond most, where that is set, so that nothing partial is returned."""
    for k in itertools.count(1):
        if most is not None and k > most:
            raise RuntimeError(f"not settled after {most} rounds")
        yield k


def chains(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(root, leaf, depth, path) for each path from a node without parents to one without children.

    A round adds one edge to every path; a path never enters a node twice, so cycles end it.
    """
    edges = edges.select("src", "dst").distinct()
    roots = edges.select("src").distinct().join(edges.select(F.col("dst").alias("src")), "src", "left_anti")
    paths = roots.select(F.col("src").alias("root"), F.col("src").alias("at"), F.array("src").alias("path"))
    inner = edges.select("src").distinct()
    done = None
    for k in _rounds(most):
        grown = checkpointed(paths.join(edges, paths["at"] == edges["src"]).filter(~F.array_contains("path", F.col("dst"))).select("root", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path")))
        ended = grown.join(inner.withColumnRenamed("src", "at"), "at", "left_anti").select("root", F.col("at").alias("leaf"), (F.size("path") - 1).alias("depth"), "path")
        done = ended if done is None else done.union(ended)
        done = done if k % UNIONS else checkpointed(done)
        if grown.isEmpty():
            break
        paths = grown
    return done


def closure(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(start, node, depth): everything that a start needs, at its greatest distance; edges go from user to need.

    On a cycle there is no greatest distance: a walk longer than the edges have users raises.
    """
    edges = checkpointed(edges.select("src", "dst").distinct())
    users = edges.select("src").distinct().count()
    found = front = starts.select(F.col("node").alias("start"), "node").withColumn("depth", F.lit(0))
    rounds = _rounds(most)
    sorted_edges = edges.hint("merge")  # neither side goes through the driver, small as it may look to a round
    while True:
        batch = []
        for depth in itertools.islice(rounds, LEVELS):  # written together, in one job
            front = front.join(sorted_edges, front["node"] == sorted_edges["src"]).select("start", F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(depth))
            batch.append(front)
        written = checkpointed(reduce(DataFrame.union, batch))
        front = written.filter(F.col("depth") == depth)
        found = checkpointed(found.union(written)) if depth % (LEVELS * LEVELS) == 0 else found.union(written)
        if front.isEmpty():
            break
        if depth > users:
            raise ValueError("a cycle has no greatest distance")
    return found.groupBy("start", "node").agg(F.max("depth").alias("depth"))


def layer_states(layers: DataFrame, needs: DataFrame, most: int | None = None) -> DataFrame:
    """(layer, state) from (layer, source_kind, present, result, has_producer) and needs (layer, input), to a fixpoint.

    A file is RESOLVED if present, else KNOWN_MISSING. An analysis result without a producer is UNKNOWN_CONTRACT, as is any
    other kind; with an active result it is COMPLETE, with a failed one FAILED. Otherwise its inputs decide: all resolved or
    complete (or none): READY_TO_RUN; one missing from the table, known missing, blocked, failed, unknown or on a cycle:
    BLOCKED_BY_INPUT; else one is only ready: KNOWN_MISSING. A round settles what depends on settled layers; what never settles lies on a cycle.
    """
    file, analysis = F.col("source_kind") == "file", F.col("source_kind") == "analysis_result"
    fixed = F.when(file, F.when(F.coalesce("present", F.lit(False)), RESOLVED).otherwise(MISSING)).when(~F.coalesce(analysis, F.lit(False)) | ~F.col("has_producer"), UNKNOWN).when(F.col("result") == "active", COMPLETE).when(F.col("result") == "failed", FAILED)
    states = checkpointed(layers.select("layer", fixed.alias("state")))
    needs = needs.select("layer", "input").distinct()
    for _ in _rounds(most):
        of_input = states.select(F.col("layer").alias("input"), F.col("state").alias("s"), F.lit(True).alias("known"))
        seen = needs.join(of_input, "input", "left")
        bad = F.col("known").isNull() | F.col("s").isin(MISSING, BLOCKED, FAILED, UNKNOWN)
        rolled = seen.groupBy("layer").agg(
            F.coalesce(F.bool_or(bad), F.lit(False)).alias("bad"),
            F.bool_or(F.col("known") & F.col("s").isNull()).alias("open"),
            F.coalesce(F.bool_and(F.col("s").isin(RESOLVED, COMPLETE)), F.lit(False)).alias("all_resolved"),
        )
        joined = states.join(rolled, "layer", "left")
        decided = F.when(F.coalesce("bad", F.lit(False)), BLOCKED).when(F.coalesce("open", F.lit(False)), None).when(F.coalesce("all_resolved", F.lit(True)), READY).otherwise(MISSING)
        new = checkpointed(joined.select("layer", F.coalesce("state", decided).alias("state")))
        before, after = states.filter("state is null").count(), new.filter("state is null").count()
        states = new
        if after == 0 or after == before:
            break
    return states.select("layer", F.coalesce("state", F.lit(BLOCKED)).alias("state"))


def roll_up(parents: DataFrame, members: DataFrame) -> DataFrame:
    """(parent, state) from members (parent, state): without any HIDDEN; all resolved or complete: COMPLETE; all ready: READY_TO_RUN;
    one failed: FAILED; all missing, blocked or unknown: BLOCKED; else PARTIAL."""
    all_ = lambda *names: F.bool_and(F.col("state").isin(*names))
    agg = members.groupBy("parent").agg(all_(RESOLVED, COMPLETE).alias("done"), all_(READY).alias("ready"), F.bool_or(F.col("state") == FAILED).alias("failed"), all_(MISSING, BLOCKED, UNKNOWN).alias("stuck"))
    state = F.when(F.col("done").isNull(), "HIDDEN").when(F.col("done"), COMPLETE).when(F.col("ready"), READY).when(F.col("failed"), FAILED).when(F.col("stuck"), "BLOCKED").otherwise("PARTIAL")
    return parents.select("parent").distinct().join(agg, "parent", "left").select("parent", state.alias("state"))


def ready_actions(states: DataFrame, producers: DataFrame) -> DataFrame:
    """(analysis_id, produces, label) for each producer of a layer that is ready to run; producers is (layer, analysis_id)."""
    found = states.filter(F.col("state") == READY).join(producers, "layer")
    return found.select("analysis_id", F.col("layer").alias("produces"), F.concat(F.lit("Run "), "analysis_id", F.lit(" to produce "), F.col("layer").cast("string")).alias("label")).distinct()


def unique_match(requests: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """(request, status, match): 'ok' with the one row that fits, 'missing' with none, 'ambiguous' with several."""
    joined = requests.join(rows, on, "left").groupBy("request").agg(F.count("row_id").alias("n"), F.min("row_id").alias("row_id"))
    return joined.select("request", F.when(F.col("n") == 1, "ok").when(F.col("n") == 0, "missing").otherwise("ambiguous").alias("status"), F.when(F.col("n") == 1, F.col("row_id")).alias("match"))


def edge_violations(edges: DataFrame, nodes: DataFrame, rules: DataFrame, layers: DataFrame, analyses: DataFrame, hooks: DataFrame) -> DataFrame:
    """(src, dst, edge_type, problem) for edges whose ends are unknown, whose types no rule allows, or whose rule's constraint fails.

    nodes are (node, node_type, entity_type, ref), ref being the id of the layer, analysis or hook; rules are (from_type, to_type, edge_type,
    constraint); layers (layer_id, entity_type); analyses (analysis_id, input_layer_types, produces) and hooks (hook_id,
    requires_layers, optional_layers) with comma lists. Constraints are always, entity_type_match, layer_in_inputs,
    layer_in_produces and layer_in_requires_or_optional; any other is a problem itself.
    """
    of_layer = layers.select(F.col("layer_id").alias("ref"), F.col("entity_type").alias("_layer_entity"))
    known = nodes.join(of_layer, "ref", "left").select("node", "node_type", "ref", F.nullif(F.coalesce("entity_type", F.lit("")), F.lit("")).alias("own"), F.nullif(F.coalesce("_layer_entity", F.lit("")), F.lit("")).alias("of_layer"))
    end = lambda side, p: known.select(F.col("node").alias(side), F.col("node_type").alias(f"{p}_type"), F.col("ref").alias(f"{p}_ref"), F.col("own").alias(f"{p}_own"), F.coalesce("own", "of_layer").alias(f"{p}_entity"))
    typed = edges.join(end("src", "from"), "src", "left").join(end("dst", "to"), "dst", "left")
    ruled = typed.join(rules.select("from_type", "to_type", "edge_type", "constraint", F.lit(True).alias("_rule")).dropDuplicates(["from_type", "to_type", "edge_type"]), ["from_type", "to_type", "edge_type"], "left")
    listed = [
        analyses.select(F.lit("layer_in_inputs").alias("constraint"), F.col("analysis_id").alias("_owner"), F.explode(csv_items(F.col("input_layer_types"))).alias("_layer")),
        analyses.select(F.lit("layer_in_produces"), "analysis_id", F.explode(csv_items(F.col("produces")))),
        hooks.select(F.lit("layer_in_requires_or_optional"), "hook_id", F.explode(F.concat(csv_items(F.col("requires_layers")), csv_items(F.col("optional_layers"))))),
    ]
    allowed = listed[0].union(listed[1]).union(listed[2]).distinct().withColumn("_in", F.lit(True))
    makes = F.col("constraint") == "layer_in_produces"
    asked = ruled.withColumn("_owner", F.when(makes, F.col("from_ref")).otherwise(F.col("to_ref"))).withColumn("_layer", F.when(makes, F.col("to_ref")).otherwise(F.col("from_ref")))
    met = asked.join(allowed, ["constraint", "_owner", "_layer"], "left")
    entity = F.when(F.col("from_own").isNull() | F.col("to_entity").isNull(), "entity_type_match: no type").when(F.col("from_own") != F.col("to_entity"), "entity_type_match")
    listed_in = F.col("constraint").isin("layer_in_inputs", "layer_in_produces", "layer_in_requires_or_optional")
    constraint = F.when(F.coalesce("constraint", F.lit("always")) == "always", None).when(F.col("constraint") == "entity_type_match", entity).when(listed_in, F.when(F.col("_in").isNull(), F.col("constraint"))).otherwise(F.lit("unknown constraint"))
    problem = F.when(F.col("from_type").isNull(), "unknown_source").when(F.col("to_type").isNull(), "unknown_target").when(F.col("_rule").isNull(), "no_rule").otherwise(constraint)
    return met.withColumn("problem", problem).filter("problem is not null").select("src", "dst", "edge_type", "problem")


def connections(registries: dict[str, DataFrame]) -> DataFrame:
    """(src, dst, kind): the edges of a connection map, of twelve kinds, from the registries that are given.

    analyses (analysis_id, input_layer_types, produces), hooks (hook_id, requires_layers, optional_layers), panels (panel_id, layer_id),
    pages (page_id, panels, hook_id), packages (package_id, analyses, panels), adapters (analysis_id), products (product_id, atlas),
    questions (question_id, tags) and atlases (atlas_id); lists are comma lists.
    """
    edge = lambda src, dst, kind: [src.cast("string").alias("src"), dst.cast("string").alias("dst"), F.lit(kind).alias("kind")]
    each = lambda df, c: df.withColumn("_x", F.explode(csv_items(F.col(c))))
    some = lambda df, c: df.filter(F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    x, parts = F.col("_x"), []
    if (t := registries.get("analyses")) is not None:
        parts += [each(t, "input_layer_types").select(*edge(x, F.col("analysis_id"), "input")), each(t, "produces").select(*edge(F.col("analysis_id"), x, "output"))]
    if (t := registries.get("hooks")) is not None:
        parts += [each(t, "requires_layers").select(*edge(x, F.col("hook_id"), "hook_required")), each(t, "optional_layers").select(*edge(x, F.col("hook_id"), "hook_optional"))]
    if (t := registries.get("panels")) is not None:
        parts.append(t.select(*edge(F.col("layer_id"), F.col("panel_id"), "panel_renders")))
    if (t := registries.get("pages")) is not None:
        parts += [each(t, "panels").select(*edge(x, F.col("page_id"), "page_member")), some(t, "hook_id").select(*edge(F.col("hook_id"), F.col("page_id"), "page_hook"))]
    if (t := registries.get("packages")) is not None:
        parts += [each(t, "analyses").select(*edge(x, F.col("package_id"), "package_analysis")), each(t, "panels").select(*edge(x, F.col("package_id"), "package_panel"))]
    if (t := registries.get("adapters")) is not None:
        parts.append(t.select(*edge(F.concat(F.col("analysis_id"), F.lit("_adapter")), F.col("analysis_id"), "adapter_backs")))
    if (atlases := registries.get("atlases")) is not None:
        names = atlases.select(F.col("atlas_id").alias("atlas"))
        if (t := registries.get("products")) is not None:
            parts.append(t.join(names, "atlas", "left_semi").select(*edge(F.col("product_id"), F.col("atlas"), "atlas_member_product")))
        if (t := registries.get("questions")) is not None:
            tagged = lambda *names: F.arrays_overlap(csv_items(F.col("tags")), F.array(*map(F.lit, names)))
            atlas = F.when(tagged("meiosis", "interchromosomal"), "meiosis_atlas").when(tagged("mendelian", "path_a", "path_b"), "relatedness_atlas").when(tagged("inversions", "pair_relation"), "inversion_atlas")
            parts.append(t.withColumn("atlas", atlas).join(names, "atlas", "left_semi").select(*edge(F.col("question_id"), F.col("atlas"), "atlas_member_question")))
    return reduce(DataFrame.union, parts)


def connection_warnings(registries: dict[str, DataFrame]) -> DataFrame:
    """(kind, id, unknown): adapters of unknown analyses, panels of unknown layers, pages of unknown panels or hooks."""
    empty = lambda df, c: F.coalesce(df[c].cast("string"), F.lit(""))
    checks = [
        ("adapter", registries["adapters"].select(F.col("analysis_id").alias("id"), F.col("analysis_id").alias("unknown")), registries["analyses"], "analysis_id"),
        ("panel", registries["panels"].select(F.col("panel_id").alias("id"), F.col("layer_id").alias("unknown")), registries["layers"], "layer_id"),
        ("page_panel", registries["pages"].select(F.col("page_id").alias("id"), F.explode(csv_items(F.col("panels"))).alias("unknown")), registries["panels"], "panel_id"),
        ("page_hook", registries["pages"].filter(empty(registries["pages"], "hook_id") != "").select(F.col("page_id").alias("id"), F.col("hook_id").alias("unknown")), registries["hooks"], "hook_id"),
    ]
    found = [rows.withColumn("unknown", F.col("unknown").cast("string")).join(known.select(F.col(key).cast("string").alias("unknown")), "unknown", "left_anti").select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "unknown") for kind, rows, known, key in checks]
    return reduce(DataFrame.union, found)


def registry_problems(analyses: DataFrame, modes: DataFrame, modules: DataFrame, results: DataFrame, statuses: list[str]) -> DataFrame:
    """(rule, id, value) where the analysis registry breaks a rule.

    analyses (analysis_id, analysis_version, status, requires, produces): ids not empty and once, versions not empty, statuses among those
    given, required ids known. modes (analysis_type, produces, module_name): types known, products declared by their analysis
    where it declares any, modules known. results (result_id, analysis_type): types known.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = analyses.filter(text("analysis_id") != "")
    ids = named.select("analysis_id").distinct()
    out = lambda df, rule, i, v: df.select(F.lit(rule).alias("rule"), i.cast("string").alias("id"), v.cast("string").alias("value"))
    aid, nothing = F.col("analysis_id"), F.lit(None).cast("string")
    required = named.select("analysis_id", F.explode(csv_items(F.col("requires"))).alias("upstream"))
    of_type = modes.filter(text("analysis_type") != "")
    declared = named.select(aid.alias("analysis_type"), F.explode(csv_items(F.col("produces"))).alias("_made"))
    produced = of_type.filter(F.trim(text("produces")) != "").withColumn("_made", F.trim("produces")).join(declared.select("analysis_type").distinct(), "analysis_type", "left_semi")
    unknown = lambda df, c, known, key: df.filter(text(c) != "").join(known.select(F.col(key).alias(c)).distinct(), c, "left_anti")
    parts = [
        out(analyses.filter(text("analysis_id") == ""), "empty id", nothing, nothing),
        out(named.groupBy("analysis_id").count().filter("count > 1"), "duplicate id", aid, F.col("count")),
        out(named.filter(text("analysis_version") == ""), "empty version", aid, nothing),
        out(named.filter(~text("status").isin(*statuses)), "status", aid, F.col("status")),
        out(required.join(ids.withColumnRenamed("analysis_id", "upstream"), "upstream", "left_anti"), "requires", aid, F.col("upstream")),
        out(unknown(of_type, "analysis_type", ids, "analysis_id"), "mode type", F.col("analysis_type"), F.col("produces")),
        out(produced.join(declared, ["analysis_type", "_made"], "left_anti"), "mode product", F.col("analysis_type"), F.col("_made")),
        out(unknown(modes, "module_name", modules, "module_name"), "module", F.col("analysis_type"), F.col("module_name")),
        out(unknown(results, "analysis_type", ids, "analysis_id"), "result type", F.col("result_id"), F.col("analysis_type")),
    ]
    return reduce(DataFrame.union, parts)


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, root): each node of undirected edges (a, b) with the least node of its component.

    Every round a node takes the least root among itself and its neighbours, and then that root's own root,
    so paths halve.
    """
    both = checkpointed(edges.select(F.col("a").alias("node"), F.col("b").alias("next")).union(edges.select("b", "a")).distinct())
    roots = checkpointed(both.groupBy("node").agg(F.least(F.min("next"), F.min("node")).alias("root")))
    for _ in _rounds(most):
        near = both.join(roots.select(F.col("node").alias("next"), F.col("root").alias("r")), "next").groupBy("node").agg(F.min("r").alias("r"))
        lower = roots.join(near, "node").select("node", F.least("root", "r").alias("root"))
        jumped = checkpointed(lower.join(roots.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left").select("node", F.least("root", F.coalesce("above", "root")).alias("root")))
        if jumped.join(roots, ["node", "root"], "left_anti").isEmpty():
            return jumped
        roots = jumped
    return roots


def question_states(questions: DataFrame, products: DataFrame) -> DataFrame:
    """(question, state, missing) from (question, product, required) and (product, state).

    Required products all ready, or none required: ready_to_run. One missing, blocked or deprecated (an unknown one is
    missing) and none ready, validated or available: blocked. Else partial. missing lists the missing and blocked ones.
    """
    seen = questions.filter("required").join(products.select("product", "state"), "product", "left").withColumn("state", F.coalesce("state", F.lit("missing")))
    is_ = lambda *names: F.col("state").isin(*names)
    agg = seen.groupBy("question").agg(F.bool_and(is_("ready")).alias("ready"), F.bool_or(is_("missing", "blocked", "deprecated")).alias("bad"), F.bool_or(is_("ready", "validated", "available")).alias("good"), F.array_sort(F.collect_set(F.when(is_("missing", "blocked"), F.col("product")))).alias("missing"))
    state = F.when(F.coalesce("ready", F.lit(True)), "ready_to_run").when(F.col("bad") & ~F.col("good"), "blocked").otherwise("partial")
    return questions.select("question").distinct().join(agg, "question", "left").select("question", state.alias("state"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))


def next_actions(questions: DataFrame, products: DataFrame, producers: DataFrame) -> DataFrame:
    """(question, product, action, analysis_id, label) for each required product that is missing or blocked: run its producer, or register one."""
    seen = questions.filter("required").select("question", "product").distinct().join(products, "product", "left").filter("coalesce(state, 'missing') in ('missing', 'blocked')")
    made = seen.join(producers.select("product", F.col("producer").alias("analysis_id")), "product", "left")
    run = F.col("analysis_id").isNotNull()
    label = F.when(run, F.concat(F.lit("Run "), "analysis_id", F.lit(" to produce "), "product")).otherwise(F.concat(F.lit("Register a producing analysis for "), "product"))
    return made.select("question", "product", F.when(run, "run").otherwise("register_producer").alias("action"), "analysis_id", label.alias("label"))


def dispatch(questions: DataFrame, states: DataFrame, producers: DataFrame) -> DataFrame:
    """(producer, products): one manifest for each producer of a required product that is missing or blocked."""
    wanted = questions.filter("required").select("product").distinct().join(states.filter("state in ('missing', 'blocked')"), "product", "left_semi")
    return wanted.join(producers, "product").groupBy("producer").agg(F.array_sort(F.collect_set("product")).alias("products"))


def _inputs(results: DataFrame) -> DataFrame:
    """(id, next): each result and its input, null where it has none."""
    return results.select(F.col("result_id").alias("id"), F.when(F.col("input_result_id") != "", F.col("input_result_id")).alias("next")).distinct()


def upstream_problems(results: DataFrame) -> DataFrame:
    """(result_id, problem) along input_result_id: 'missing' where a chain names nothing, 'cycle' where it comes back.

    A round doubles how far every open result looks; what still goes on after as many steps as there are results is in a cycle, or leads to one.
    """
    inputs = _inputs(results)
    ids = checkpointed(inputs.select(F.col("id").alias("next")).distinct().withColumn("known", F.lit(True)))
    size, reach = ids.count(), 1
    end = F.when(F.col("next").isNull(), "end").when(F.col("known").isNull(), "missing")
    state = checkpointed(inputs.join(ids, "next", "left").select("id", F.when(end.isNull(), F.col("next")).alias("to"), end.alias("end")))
    while reach < size and not (ahead := state.filter("end is null")).isEmpty():
        further = state.select(F.col("id").alias("to"), F.col("to").alias("beyond"), F.col("end").alias("ends"))
        stepped = ahead.join(further, "to").select("id", F.col("beyond").alias("to"), F.col("ends").alias("end"))
        state = checkpointed(state.filter("end is not null").union(stepped).distinct())
        reach *= 2
    return state.filter("end is null or end = 'missing'").select(F.col("id").alias("result_id"), F.coalesce("end", F.lit("cycle")).alias("problem")).distinct()


def chain_ends(results: DataFrame) -> DataFrame:
    """(root, leaf, depth) of each chain along input_result_id, from a result without input to one that is no input.

    A result that stands alone is a chain of its own. What hangs on an unknown input or a cycle is in no chain. A round doubles the steps taken.
    """
    inputs = checkpointed(_inputs(results))
    size, reach = inputs.count(), 1
    root = F.col("next").isNull()
    state = checkpointed(inputs.select("id", F.coalesce("next", "id").alias("to"), F.when(root, 0).otherwise(1).cast("long").alias("steps"), root.alias("done")))
    while not (ahead := state.filter("not done")).isEmpty():
        if reach >= size:
            break
        further = state.select(F.col("id").alias("to"), F.col("to").alias("beyond"), F.col("steps").alias("more"), F.col("done").alias("ends"))
        stepped = ahead.join(further, "to").select("id", F.col("beyond").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ends").alias("done"))
        state = checkpointed(state.filter("done").union(stepped))
        reach *= 2
    inner = inputs.filter("next is not null").select(F.col("next").alias("id")).distinct()
    return state.filter("done").join(inner, "id", "left_anti").select(F.col("to").alias("root"), F.col("id").alias("leaf"), F.col("steps").alias("depth"))


def chain_members(results: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """(leaf, place, result_id): the results of the chains that end in the given leaves (all, if none are given), root first at place 0.

    A round lists as many more ancestors as there are already, so its work is that of the rows that it adds.
    """
    ends = chain_ends(results)
    ends = checkpointed(ends if leaves is None else ends.join(leaves.select("leaf").distinct(), "leaf", "left_semi"))
    jumps = checkpointed(_inputs(results).filter("next is not null"))
    listed, reach = ends.select("leaf", F.col("leaf").alias("node"), F.col("depth").alias("place")), 1
    while True:
        more = listed.filter(F.col("place") >= reach).join(jumps, F.col("node") == F.col("id")).select("leaf", F.col("next").alias("node"), (F.col("place") - reach).alias("place"))
        more = checkpointed(more)
        if more.isEmpty():
            return listed.select("leaf", "place", F.col("node").alias("result_id"))
        listed = checkpointed(listed.union(more))
        further = jumps.select(F.col("id").alias("next"), F.col("next").alias("beyond"))
        jumps, reach = checkpointed(jumps.join(further, "next").select("id", F.col("beyond").alias("next"))), reach * 2
