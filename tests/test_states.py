"""The traps of state roll-ups, one by one."""

from gridtally.operators import states


def found(df, key):
    return {r[key]: r["state"] for r in df.collect()}


LAYERS = [("done", "RESOLVED"), ("full", "COMPLETE"), ("run", "READY_TO_RUN"), ("gone", "KNOWN_MISSING"), ("stuck", "BLOCKED_BY_INPUT"), ("bad", "FAILED"), ("old", "STALE"), ("odd", "UNKNOWN_CONTRACT")]


def layers(spark):
    return spark.createDataFrame(LAYERS, "layer string, state string")


def test_products(spark):
    backing = {"a": ["done", "full"], "b": ["done"], "c": ["done"], "d": ["done"], "some": ["done", "gone"], "fail": ["done", "bad"], "lost": ["bad", "nowhere"], "ready": ["run"], "bare": []}
    sure = {"a": "review_passed", "b": "preliminary", "c": "rejected", "d": "unreviewed", "some": "review_passed"}
    products = spark.createDataFrame([(p, sure.get(p)) for p in backing], "product string, confidence string")
    rows = spark.createDataFrame([(p, x) for p, v in backing.items() for x in v], "product string, layer string")
    none = spark.createDataFrame([], "product string, needs string")
    got = found(states.product_states(products, rows, layers(spark), none), "product")
    assert got == {"a": "ready", "b": "validated", "c": "blocked", "d": "available", "some": "missing", "fail": "blocked", "lost": "missing", "ready": "missing", "bare": "missing"}


def test_products_by_what_they_depend_on(spark):
    names = ["top", "mid", "low", "bare", "x", "y", "over", "self", "orphan", "aged", "uses", "uses2", "gonebelow", "fine"]
    products = spark.createDataFrame([(p, "review_passed", {"aged": "stale", "low": "deprecated"}.get(p)) for p in names], "product string, confidence string, declared string")
    backing = spark.createDataFrame([(p, "done") for p in names if p not in ("bare", "gonebelow")], "product string, layer string")
    depends = spark.createDataFrame([("top", "mid"), ("mid", "low"), ("bare", "x"), ("x", "y"), ("y", "x"), ("over", "y"), ("self", "self"), ("orphan", "nobody"), ("uses", "aged"), ("uses2", "uses"), ("gonebelow", "aged"), ("fine", None)], "product string, needs string")
    got = found(states.product_states(products, backing, layers(spark), depends), "product")
    # a bad dependency blocks even a missing product; a stale one leaves a missing product missing
    assert got == {"top": "blocked", "mid": "blocked", "low": "deprecated", "bare": "blocked", "x": "blocked", "y": "blocked", "over": "blocked", "self": "blocked", "orphan": "blocked", "aged": "stale", "uses": "stale", "uses2": "stale", "gonebelow": "missing", "fine": "ready"}


HOOKS = {"none": [], "ok": [("done", True), ("full", True), ("gone", False)], "run": [("run", True)], "half": [("done", True), ("run", True)], "gone": [("done", True), ("gone", True)], "blocked": [("gone", True), ("stuck", True)], "unknown": [("nowhere", True), ("odd", True)], "failed": [("bad", True), ("done", True)], "optional": [("done", False), ("gone", False), ("old", False)], "old": [("old", True)]}


def hooks(spark):
    return spark.createDataFrame([(h, x, r) for h, v in HOOKS.items() for x, r in v or [(None, None)]], "hook string, layer string, required boolean")


def test_hooks(spark):
    asked = spark.createDataFrame([(h,) for h in [*HOOKS, "absent"]], "hook string")
    assert found(states.hook_states(asked, hooks(spark), layers(spark)), "hook") == {"none": "RESOLVED", "ok": "RESOLVED", "run": "READY_TO_RUN", "half": "READY_TO_RUN", "gone": "BLOCKED_BY_INPUT", "blocked": "BLOCKED_BY_INPUT", "unknown": "BLOCKED_BY_INPUT", "failed": "BLOCKED_BY_INPUT", "optional": "RESOLVED", "old": "READY_TO_RUN", "absent": "UNKNOWN_CONTRACT"}
    producers = spark.createDataFrame([("run", "m2"), ("run", "m1"), ("gone", "m3")], "layer string, analysis_id string")
    shown = states.panels(hooks(spark), layers(spark), producers)
    by = {(r.hook, r.layer): (r.panel_state, [tuple(a) for a in r.actions]) for r in shown.collect()}
    assert by["run", "run"] == ("READY_TO_RUN", [("run", "Run m1", "m1"), ("run", "Run m2", "m2")]) and by["optional", "gone"] == ("HIDDEN_OPTIONAL", [])
    assert by["gone", "gone"] == ("VISIBLE_BLOCKED", [("edit_registry", "Inspect gone in the layer registry", "gone")]) and by["optional", "old"][0] == by["old", "old"][0] == "VISIBLE_PARTIAL"
    assert found(states.composed(asked, shown), "hook") == {"none": "HIDDEN", "ok": "COMPLETE", "run": "READY_TO_RUN", "half": "PARTIAL", "gone": "PARTIAL", "blocked": "BLOCKED", "unknown": "BLOCKED", "failed": "PARTIAL", "optional": "HIDDEN", "old": "PARTIAL", "absent": "HIDDEN"}


def test_plans(spark):
    """Blocked and unknown hooks aren't stuck states, so a page of those alone is partial."""
    pages = {"blocked": ["blocked"], "unknown": ["absent"], "both": ["blocked", "absent"], "ok": ["ok"], "mixed": ["ok", "run"], "run": ["run"], "failed": ["ok", "failed"], "empty": [None], "hidden": ["optional"]}
    rows = spark.createDataFrame([(p, h) for p, v in pages.items() for h in v], "page string, hook string")
    assert found(states.plan(rows, hooks(spark), layers(spark)), "page") == {"blocked": "PARTIAL", "unknown": "PARTIAL", "both": "PARTIAL", "ok": "COMPLETE", "mixed": "PARTIAL", "run": "READY_TO_RUN", "failed": "FAILED", "empty": "HIDDEN", "hidden": "PARTIAL"}


def test_estimands_and_questions(spark):
    pre = [("e1", "product", "p1", True), ("e1", "layer", "full", True), ("e2", "product", "p2", True), ("e3", "sample_attribute", "age", True), ("e3", "product", "p2", True), ("e4", "layer", "done", True), ("e4", "product", "p2", False), ("e5", None, None, None), ("e6", "colour", "p1", True), ("e7", "sample_attribute", "age", False), ("e8", "sample_attribute", "sex", True), ("e9", "sample_attribute", "nothing", None)]
    products = spark.createDataFrame([("p1", "ready"), ("p2", "missing")], "product string, state string")
    attributes = spark.createDataFrame([("age", "partial"), ("sex", "covered")], "attribute string, status string")
    asked = spark.createDataFrame([(f"e{i}",) for i in range(1, 11)], "estimand string")
    out = states.estimands(asked, spark.createDataFrame(pre, "estimand string, kind string, id string, required boolean"), products, layers(spark), attributes)
    assert found(out, "estimand") == {"e1": "estimable", "e2": "not_estimable", "e3": "needs_extra_data", "e4": "partially_estimable", "e5": "estimable", "e6": "not_estimable", "e7": "partially_estimable", "e8": "estimable", "e9": "needs_extra_data", "e10": "not_estimable"}
    of = spark.createDataFrame([("full", "e1"), ("full", "e8"), ("part", "e1"), ("part", "e4"), ("extra", "e1"), ("extra", "e3"), ("extra", "e2"), ("limited", "e2"), ("limited", "e1")], "question string, estimand string")
    questions = spark.createDataFrame([(q,) for q in ("full", "part", "extra", "limited", "none")], "question string")
    assert found(states.question_estimability(questions, of, out), "question") == {"full": "fully_estimable", "part": "partially_estimable", "extra": "needs_extra_data", "limited": "limited", "none": "unknown"}
