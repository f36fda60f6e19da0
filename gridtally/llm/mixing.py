"""Operator 6: mixing sources to target weights by entropy balancing, with DataFrame functions only.

Every document gets a rate between 0 and CAP. Among all rates whose words meet the source's
target, those of least relative entropy to an even rate are CAP / (1 + exp(-(a + tilt * x))), an
exponential tilt in the document's size x, and the tilt solves a convex dual. Newton steps on it
run distributed: documents enter through counts by (source, size), a step is one aggregation over
these counts, and sums are decimals, so reruns agree to the last digit.

The steps go on until every source's target is met. Rates become copies by rounding the running sum over
a source's sizes; what error is left is then taken off by copies, the largest sizes that fit first. Both go over a source's
distinct sizes in one task, which the longest text bounds, whatever the number of documents. A size's copies are dealt to its documents in the order of a hash; a size with
very many documents is first cut into parts of about PART rows, so no task holds them all.

Defined cases: a null or empty text has size 0, is taken 0 times and still has a row; a null source
is a source of its own, last in order; rows that repeat are dealt copies one by one
(draw gives rows that share id and size the mean of theirs, rounded up); extra columns
stay out of mix_documents and stay in draw. If no text has a word all targets are 0. Empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtally.session import checkpointed
from gridtally.llm.texts import fresh, word_count

CAP = 2
#: Newton steps at most, and the share of a target that rates may leave unmet; the correction of copies takes over.
STEPS, SLACK = 30, 1e-6
PART = 4096
_EXACT = "decimal(38,6)"


def source_targets(counts: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150) -> DataFrame:
    """(source, words, target) from (source, size, docs): one row a source.

    A target is the lesser of CAP times the source's words and a level times its weight; the level
    is such that the targets sum to percent of all words. In the order of cap per weight, the capped
    sources come first, so the level follows from running sums.
    """
    sources = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).cast("long").alias("words"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1).withColumn("weight", weight.cast("double"))
    sources = sources.withColumn("cap", F.col("words") * CAP)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    whole = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("words").over(whole) * percent / 100 - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    sources = sources.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    found = F.coalesce(F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("place"), F.col("level")))).over(whole)["level"], F.lit(float("inf")))
    return sources.select("source", "words", F.round(F.least(F.col("cap").cast("double"), found * F.col("weight")), 6).alias("target"))


def _rate(tilt: Column) -> Column:
    return F.lit(float(CAP)) / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), tilt))))


def _of_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """left with right's columns for the same source, null being a source too."""
    return left.join(right.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of")), how).drop("_of")


def balanced_rates(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, size, docs, target, words, rate): rates that meet the targets, by Newton steps on the dual."""
    # x is the size over the source's mean size, so that tilts are of order one; tilt 0 is rate 1 for all
    means = counts.groupBy("source").agg((F.sum(F.col("size") * F.col("docs")) / F.sum("docs")).alias("mean"))
    state = checkpointed(_of_source(targets, means).withColumn("tilt", F.lit(0.0)))
    x = F.col("size") / F.greatest(F.col("mean"), F.lit(1e-9))
    rate = _rate(F.col("tilt") * x)
    for step in range(1, STEPS + 1):
        taken = F.sum((F.col("docs") * F.col("size") * rate).cast(_EXACT)).cast("double")
        slope = F.sum((F.col("docs") * F.col("size") * x * rate * (1 - rate / CAP)).cast(_EXACT)).cast("double")
        held = [F.max(c).alias(c) for c in ("words", "target", "mean", "tilt")]  # one value a source
        sums = _of_source(counts, state).groupBy("source").agg(*held, taken.alias("taken"), slope.alias("slope"))
        # Newton on the logit of the share taken, which is a straight line in the tilt where all sizes are equal
        cap = F.greatest(F.col("words") * CAP, F.lit(1)).cast("double")
        share = lambda c: F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col(c) / cap))
        logit = lambda c: F.ln(share(c) / (1 - share(c)))
        move = (logit("target") - logit("taken")) * cap * share("taken") * (1 - share("taken")) / F.greatest(F.col("slope"), F.lit(1e-9))
        bound = F.lit(20.0)
        tilt = F.round(F.col("tilt") + F.greatest(-bound, F.least(bound, move)), 12)
        # at its cap a source takes all; elsewhere what is left to meet is at most SLACK of the target, or half a word
        met = (F.col("target") >= CAP * F.col("words")) | (F.abs(F.col("target") - F.col("taken")) <= F.greatest(F.lit(0.5), SLACK * F.col("target")))
        state = sums.select("source", "words", "target", "mean", F.when(met, F.col("tilt")).otherwise(tilt).alias("tilt"), met.alias("met"))
        if step % 3 == 0:
            state = checkpointed(state)
            if state.filter("not met").isEmpty():
                break
    full = F.when(F.col("target") >= CAP * F.col("words"), F.lit(float(CAP))).otherwise(rate)
    return _of_source(counts, state).select("source", "size", "docs", "target", "words", F.when(F.col("size") > 0, full).otherwise(0.0).alias("rate"))


def copies_by_size(rates: DataFrame) -> DataFrame:
    """(source, size, docs, target, words, copies): whole copies for all documents of a size."""
    in_order = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    due = F.floor(F.sum((F.col("docs") * F.col("rate")).cast(_EXACT)).over(in_order) + F.lit(0.5).cast("decimal(2,1)")).cast("long")
    summed = rates.withColumn("due", due)
    step = Window.partitionBy("source").orderBy("size")
    copies = F.col("due") - F.coalesce(F.lag("due").over(step), F.lit(0))
    return summed.select("source", "size", "docs", "target", "words", F.when(F.col("size") > 0, copies).otherwise(0).alias("copies"))


def corrected(plan: DataFrame) -> DataFrame:
    """plan with copies more or less where rounding left a source off its target.

    A fold over a source's distinct sizes, the largest first, takes as many copies of each as fit into the error that
    is left; the last copy may be of a larger size if that comes nearer.
    """
    meant = F.max(F.least(F.col("target"), CAP * F.col("words").cast("double")))
    over = (F.sum(F.col("size") * F.col("copies")) - meant).alias("over")
    listed = plan.groupBy("source").agg(over, F.sort_array(F.collect_list(F.struct("size", "docs", "copies")), asc=False).alias("items"))
    room = lambda x: F.when(F.col("over") > 0, x["copies"]).otherwise(CAP * x["docs"] - x["copies"])
    open_ = listed.withColumn("items", F.filter(F.transform("items", lambda x: F.struct(x["size"].alias("size"), room(x).alias("room"))), lambda x: (x["size"] > 0) & (x["room"] > 0)))

    def take(acc, x):
        n = F.least(x["room"], F.floor(acc["error"] / x["size"]).cast("long"))
        one = F.array(F.struct(x["size"].alias("size"), n.alias("n"), (n == x["room"]).alias("all")))
        return F.struct((acc["error"] - n * x["size"]).alias("error"), F.when(n > 0, F.concat(acc["moves"], one)).otherwise(acc["moves"]).alias("moves"))

    none = F.array().cast("array<struct<size:bigint,n:bigint,all:boolean>>")
    done = open_.withColumn("x", F.aggregate("items", F.struct(F.abs("over").alias("error"), none.alias("moves")), take))
    free = lambda x: ~F.exists("x.moves", lambda m: m["all"] & (m["size"] == x["size"]))
    nearer = F.filter("items", lambda x: (x["size"] > F.col("x.error")) & (x["size"] - F.col("x.error") < F.col("x.error")) & free(x))
    last = F.array_min(F.transform(nearer, lambda x: x["size"]))
    moves = F.when(last.isNull(), F.col("x.moves")).otherwise(F.concat("x.moves", F.array(F.struct(last.alias("size"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("all")))))
    each = done.select("source", (-F.signum("over")).cast("long").alias("sign"), F.explode(moves).alias("m"))
    summed = each.groupBy(F.col("source").alias("_s"), F.col("m.size").alias("_z")).agg(F.sum(F.col("sign") * F.col("m.n")).alias("_n"))
    joined = plan.join(summed, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")), "left")
    return joined.withColumn("copies", F.col("copies") + F.coalesce("_n", F.lit(0))).drop("_s", "_z", "_n")


def _sized(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return docs.withColumn("_size", word_count(text)).withColumn("_order", F.xxhash64(F.lit(11), "doc_id", "text"))


def _dealt(rows: DataFrame, weights: tuple[int, ...], percent: int) -> DataFrame:
    """rows, with source, _size and _order, and beside them words, target and _copies."""
    counts = rows.groupBy("source", F.col("_size").alias("size")).agg(F.count("*").alias("docs"))
    counts = checkpointed(counts)
    plan = checkpointed(corrected(copies_by_size(balanced_rates(counts, source_targets(counts, weights, percent)))))
    plan = plan.select(F.col("source").alias("_source"), F.col("size").alias("_of_size"), "docs", "target", "words", "copies")
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_size") == F.col("_of_size"))).drop("_source", "_of_size")
    # parts of a size hold about PART rows each; a part's share of the copies follows its place
    parts = F.ceil(F.col("docs") / PART)
    joined = joined.withColumn("_part", F.pmod(F.col("_order"), parts))
    held = joined.filter(F.col("docs") > PART).groupBy("source", "_size", "_part").agg(F.count("*").alias("in_part"), F.first("docs").alias("docs"), F.first("copies").alias("copies"))
    upto = F.sum("in_part").over(Window.partitionBy("source", "_size").orderBy("_part"))
    share = lambda n: F.floor(F.col("copies") * n / F.col("docs")).cast("long")
    held = held.withColumn("upto", upto).select(F.col("source").alias("_s"), F.col("_size").alias("_z"), F.col("_part").alias("_p"), "in_part", (share(F.col("upto")) - share(F.col("upto") - F.col("in_part"))).alias("part_copies"))
    joined = joined.join(held, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")) & (F.col("_part") == F.col("_p")), "left").drop("_s", "_z", "_p")
    n, copies = F.coalesce("in_part", "docs"), F.coalesce("part_copies", "copies")
    rank = F.row_number().over(Window.partitionBy("source", "_size", "_part").orderBy("_order", "doc_id"))
    each = F.floor(copies / F.greatest(n, F.lit(1)))
    return joined.withColumn("_copies", (each + (rank <= F.pmod(copies, F.greatest(n, F.lit(1)))).cast("long")).cast("long"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for each row of docs."""
    rows = _sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", "_size", "_order")
    out = _dealt(checkpointed(rows), weights, percent)
    return out.select("doc_id", F.col("_size").alias("size"), F.col("words").alias("source_size"), "target", (F.col("_copies") * F.col("_size")).alias("taken"), F.col("_copies").alias("copies"))


def draw(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, all columns as they are."""
    key, size, times, words = (fresh(docs.columns, n) for n in ("_id", "_size", "_times", "_words"))
    taken = mix_documents(docs, weights, percent).groupBy(F.col("doc_id").alias(key), F.col("size").alias(size)).agg(F.ceil(F.sum("copies") / F.count("*")).cast("int").alias(times))
    rows = docs.withColumn(words, word_count(F.col("text"))).join(taken, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(words) == F.col(size)))
    return rows.withColumn(words, F.explode(F.array_repeat(F.lit(1), F.col(times)))).select(*docs.columns)
