"""Seeded classes of samples along one coordinate, how well two or three of them fit, and carriers that persist over distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtally.session import checkpointed

BROADCAST_GROUPS = 10_000
CLASSES = {2: ("HOM_REF", "HOM_INV"), 3: ("HOM_REF", "HET", "HOM_INV")}


def _mean(value: str):
    """A mean that doesn't depend on the order of rows."""
    return F.sum(F.col(value).cast("decimal(38,12)")).cast("double") / F.count(value)


def seed_centres(points: DataFrame, seeds: DataFrame, labels: Sequence[str], least: int) -> DataFrame:
    """(group, centres, seeded): the mean coordinate of each label's seeds, an array in the order of labels; seeded is false where one has fewer than least."""
    of = points.join(seeds.filter(F.col("label").isin(list(labels))).select("group", "id", "label").distinct(), ["group", "id"])
    means = of.groupBy("group", "label").agg(_mean("x").alias("c"), F.count("*").alias("n"))
    wide = means.groupBy("group").agg(*(F.max(F.when(F.col("label") == k, F.when(F.col("n") >= least, F.col("c")))).alias(f"_{i}") for i, k in enumerate(labels)))
    centres = F.array(*(F.col(f"_{i}") for i in range(len(labels))))
    out = points.select("group").distinct().join(wide.select("group", centres.alias("centres")), "group", "left")
    return out.withColumn("seeded", F.coalesce(F.size("centres") == F.size(F.array_compact("centres")), F.lit(False)))


def _placed(points: DataFrame, centres: DataFrame, broadcast: bool) -> DataFrame:
    """points with at, the place of the nearest centre, the first on a tie, and away, its squared distance."""
    joined = points.join(F.broadcast(centres) if broadcast else centres, "group")
    near = F.array_min(F.transform("centres", lambda c, i: F.struct(F.abs(F.col("x") - c).alias("d"), i.alias("at"))))
    return joined.select(*points.columns, near["at"].alias("at"), (near["d"] * near["d"]).alias("away"))


def lloyd(points: DataFrame, centres: DataFrame, rounds: int = 300) -> DataFrame:
    """(group, centres) where no point of (group, id, x) changes its centre any more; raises if one does after `rounds`.

    A round is one aggregation over the groups that still move, by partial sums, so that a large group is many tasks. Points are written
    once, so that no round makes them again. A centre without points stays where it is.
    """
    points = checkpointed(points.select("group", "x"))
    open_ = checkpointed(centres.select("group", "centres"))
    left, done = open_.count(), []
    small = left <= BROADCAST_GROUPS
    for _ in range(rounds):
        if left == 0:
            break
        sums = _placed(points, open_, small).groupBy("group", "at").agg(_mean("x").alias("c"))
        new = sums.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("at", "c"))).alias("m"))  # an entry a centre
        moved = open_.join(new, "group", "left").select("group", "centres", F.transform("centres", lambda c, i: F.coalesce(F.try_element_at("m", i), c)).alias("next"))
        moved = checkpointed(moved)
        done.append(moved.filter("centres = next").select("group", "centres"))
        open_ = moved.filter("centres <> next").select("group", F.col("next").alias("centres"))
        left = open_.count()
    if left:
        raise RuntimeError(f"{left} groups still move after {rounds} rounds")
    out = open_
    for part in done:
        out = out.unionByName(part)
    return out


def seeded_classes(points: DataFrame, seeds: DataFrame, k: int, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """((group, id, label), (group, n, status, rss, bic)) of seeded k-means for k of 2 or 3 along x.

    points is (group, id, x), points without x are left out; seeds is (group, id, label). A group without `least` seeds of each label is
    stamped no_seeding and gets no labels. bic is that of Gaussian classes of one variance: n ln(2 pi rss / n) + n - 2 sum of
    n_j ln(n_j / n) + 2 k ln n; null where rss is 0.
    """
    labels = CLASSES[k]
    points = points.filter("x is not null").select("group", "id", F.col("x").cast("double").alias("x"))
    start = checkpointed(seed_centres(points, seeds, labels, least))
    end = lloyd(points, start.filter("seeded"))
    placed = _placed(points, end, start.count() <= BROADCAST_GROUPS)
    names = F.array(*map(F.lit, labels))
    sizes = placed.groupBy("group", "at").agg(F.count("*").alias("m"), F.sum(F.col("away").cast("decimal(38,12)")).alias("rss"))
    n = F.sum("m").cast("double")
    spread = sizes.groupBy("group").agg(F.sum("rss").cast("double").alias("rss"), (F.sum(F.col("m") * F.ln("m")) - n * F.ln(n)).alias("mixed"))
    counts = points.groupBy("group").agg(F.count("*").alias("n"))
    size = F.col("n").cast("double")
    bic = F.when(F.col("rss") > 0, size * F.ln(6.283185307179586 * F.col("rss") / size) + size - 2 * F.col("mixed") + 2 * k * F.ln(size))
    fits = start.join(counts, "group").join(spread, "group", "left").select("group", "n", F.when(F.col("seeded"), "ok").otherwise("no_seeding").alias("status"), "rss", bic.alias("bic"))
    return placed.select("group", "id", F.get(names, F.col("at")).alias("label")), fits


def class_quality(points: DataFrame, seeds: DataFrame, phased: DataFrame, least: int = 2) -> DataFrame:
    """(group, n, status, bic_gap_k3_vs_k2, n_het, n_het_phase_supported, het_phase_support_fraction).

    The gap is BIC(k=2) - BIC(k=3); the fraction is of samples in the middle class that phased (group, id, supported) supports.
    """
    labelled, three = seeded_classes(points, seeds, 3, least)
    _, two = seeded_classes(points, seeds, 2, least)
    held = phased.filter("supported").select("group", "id").distinct().withColumn("held", F.lit(True))
    het = labelled.filter("label = 'HET'").join(held, ["group", "id"], "left").groupBy("group").agg(F.count("*").alias("n_het"), F.count("held").alias("n_het_phase_supported"))
    out = three.join(two.select("group", F.col("bic").alias("bic2")), "group", "left").join(het, "group", "left")
    zero = lambda c: F.when(F.col("status") == "ok", F.coalesce(c, F.lit(0).cast("long"))).alias(c)
    return out.select("group", "n", "status", (F.col("bic2") - F.col("bic")).alias("bic_gap_k3_vs_k2"), zero("n_het"), zero("n_het_phase_supported"), (F.col("n_het_phase_supported") / F.col("n_het")).alias("het_phase_support_fraction"))


def persistent_pairs(pairs: DataFrame, high: float = 0.8) -> DataFrame:
    """(candidate, a, b) of (candidate, a, b, distance, concordance) above `high` at every distance that its candidate was tested at."""
    tested = pairs.groupBy("candidate").agg(F.countDistinct("distance").alias("tested"))
    held = pairs.filter(F.col("concordance") > high).groupBy("candidate", "a", "b").agg(F.countDistinct("distance").alias("held"))
    return held.join(tested, "candidate").filter("held = tested").select("candidate", "a", "b")


def persistent_carriers(pairs: DataFrame, high: float = 0.8) -> DataFrame:
    """(candidate, sample): those of a persistent pair."""
    return persistent_pairs(pairs, high).select("candidate", F.explode(F.array("a", "b")).alias("sample")).distinct()


def carrier_scores(pairs: DataFrame, high: float = 0.8, fall: float = 0.3) -> DataFrame:
    """(candidate, n_pairs, n_persistent, n_decaying, score): pairs that persist against pairs that fall by over `fall` from their shortest distance.

    score is the share of the persistent among both, null without any.
    """
    best = pairs.groupBy("candidate", "a", "b").agg(F.min_by("concordance", F.struct("distance", -F.col("concordance"))).alias("near"), F.min("concordance").alias("low"))
    counts = best.groupBy("candidate").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("near") - F.col("low") > fall).alias("n_decaying"))
    kept = persistent_pairs(pairs, high).groupBy("candidate").agg(F.count("*").alias("n_persistent"))
    out = counts.join(kept, "candidate", "left").withColumn("n_persistent", F.coalesce("n_persistent", F.lit(0).cast("long")))
    both = F.col("n_persistent") + F.col("n_decaying")
    return out.select("candidate", "n_pairs", "n_persistent", "n_decaying", F.when(both > 0, F.col("n_persistent") / both).alias("score"))
