"""Group statistics: frequencies, diversity, differentiation, pairwise correlation, contingency, relatedness.

Estimators for diversity and differentiation are those of the literature, chosen here: Nei (1978) for
expected heterozygosity, Watterson (1975), Tajima (1989), Nei's dxy, and Hudson's Fst as a ratio of
averages (Bhatia et al. 2013). KING-robust kinship follows Manichaikul et al. (2010).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtally.operators import ranges
from gridtally.session import checkpointed

#: Pairs of samples at a site that one task makes or counts.
PAIRS_PER_TASK = 1_000_000
#: Blocks of up to so many samples are broadcast.
BROADCAST_SAMPLES = 1_000_000


def dosage_code(cell: Column) -> Column:
    """A genotype cell as 0, 1 or 2, and -1 for anything else."""
    value = F.trim(cell.cast("string"))
    return F.when(value.isin("0", "1", "2"), value.cast("tinyint")).otherwise(F.lit(-1).cast("tinyint"))


def group_means(long: DataFrame, groups: DataFrame, values: Sequence[str], window: str) -> DataFrame:
    """Per group and window the mean of each value over the group's samples, and n of samples seen at all.

    Windows are those of all samples together; a group without a sample there has nulls, and an empty
    group has n = 0 throughout.
    """
    windows = long.select(window).distinct()
    names = groups.select("group_name").distinct()
    joined = long.join(groups.filter("sample is not null").distinct(), "sample")
    means = joined.groupBy("group_name", window).agg(*((F.sum(F.nanvl(F.col(v), F.lit(None).cast("double")).cast("decimal(38,9)")).cast("double") / F.count(F.nanvl(F.col(v), F.lit(None).cast("double")))).alias(v) for v in values))
    seen = joined.groupBy("group_name").agg(F.countDistinct("sample").alias("n"))
    grid = windows.withColumn("_one", F.lit(1)).join(F.broadcast(names.withColumn("_one", F.lit(1))), "_one").drop("_one")
    out = grid.join(means, ["group_name", window], "left").join(F.broadcast(seen), "group_name", "left")
    return out.select("group_name", window, F.coalesce("n", F.lit(0)).alias("n"), *values)


def wide_cells(wide: DataFrame, window: str, samples: Sequence[str]) -> DataFrame:
    """(window, sample, k, q) from one column a sample whose cells are 'q1,q2,…'."""
    long = wide.unpivot([window], list(samples), "sample", "cell").filter("cell is not null and trim(cell) <> ''")
    return long.select(window, "sample", F.posexplode(F.split("cell", ",")).alias("k", "part")).select(window, "sample", (F.col("k") + 1).alias("k"), F.trim("part").try_cast("double").alias("q"))


def frequencies(dosages: DataFrame) -> DataFrame:
    """(site, group_name, n, alt): called samples and alternative alleles; -1 is not called."""
    return dosages.filter("dosage >= 0").groupBy("site", "group_name").agg(F.count("*").alias("n"), F.sum("dosage").cast("long").alias("alt"))


def diversity(freqs: DataFrame, per_window: int) -> DataFrame:
    """Per group and window of sites: n_sites, segregating sites, theta_pi and theta_w per site, mean n.

    A site's pi is 2 * alt * ref / (2n * (2n - 1)); theta_w is S over the harmonic sum for the window's mean n.
    """
    n2 = 2 * F.col("n")
    pi = 2 * F.col("alt") * (n2 - F.col("alt")) / (n2 * (n2 - 1))
    sites = freqs.filter("n >= 1").withColumn("win_idx", F.floor(F.col("site") / per_window).cast("long")).withColumn("pi", pi).withColumn("seg", ((F.col("alt") > 0) & (F.col("alt") < n2)).cast("int"))
    win = sites.groupBy("group_name", "win_idx").agg(F.count("*").alias("n_sites"), F.sum("seg").cast("long").alias("s"), (F.sum(F.col("pi").cast("decimal(38,12)")).cast("double")).alias("sum_pi"), F.floor(F.sum("n") / F.count("*")).cast("long").alias("mean_n"))
    a1 = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(2 * F.col("mean_n") - 1, F.lit(1))), F.lit(0.0), lambda acc, i: acc + 1.0 / i)
    return win.withColumn("a1", a1).select("group_name", "win_idx", "n_sites", "s", "mean_n", (F.col("sum_pi") / F.col("n_sites")).alias("theta_pi"), (F.col("s") / F.col("a1") / F.col("n_sites")).alias("theta_w"))


def window_tajima(freqs: DataFrame, per_window: int) -> DataFrame:
    """(group_name, win_idx, n_sites, s, d): Tajima's D of each window from its own sites, with the mean number of called samples."""
    win = diversity(freqs, per_window)
    d = tajima_d(2 * F.col("mean_n"), F.col("s"), F.col("theta_pi") * F.col("n_sites"))
    return win.select("group_name", "win_idx", "n_sites", "s", F.when(F.col("mean_n") > 1, d).alias("d"))


def tajima_d(n2: Column, s: Column, pi_total: Column) -> Column:
    """Tajima's D from the number of sequences, segregating sites and the sum of pi; null without segregating sites."""
    series = F.sequence(F.lit(1).cast("long"), n2 - 1)
    a1 = F.aggregate(series, F.lit(0.0), lambda acc, i: acc + 1.0 / i)
    a2 = F.aggregate(series, F.lit(0.0), lambda acc, i: acc + 1.0 / (i * i))
    b1, b2 = (n2 + 1) / (3 * (n2 - 1)), 2 * (n2 * n2 + n2 + 3) / (9 * n2 * (n2 - 1))
    e1 = (b1 - 1 / a1) / a1
    e2 = (b2 - (n2 + 2) / (a1 * n2) + a2 / (a1 * a1)) / (a1 * a1 + a2)
    return F.when((s > 0) & (n2 > 2), (pi_total - s / a1) / F.sqrt(e1 * s + e2 * s * (s - 1)))


def divergence(freqs: DataFrame, per_window: int) -> DataFrame:
    """Per pair of groups and window: n_sites called in both, mean dxy, and Hudson's Fst as a ratio of averages."""
    a = freqs.select("site", F.col("group_name").alias("group_a"), F.col("n").alias("na"), F.col("alt").alias("xa"))
    b = freqs.select("site", F.col("group_name").alias("group_b"), F.col("n").alias("nb"), F.col("alt").alias("xb"))
    both = a.join(b, "site").filter("group_a < group_b and na > 0 and nb > 0")
    p, q = F.col("xa") / (2 * F.col("na")), F.col("xb") / (2 * F.col("nb"))
    dxy = p * (1 - q) + q * (1 - p)
    num = (p - q) * (p - q) - p * (1 - p) / F.greatest(2 * F.col("na") - 1, F.lit(1)) - q * (1 - q) / F.greatest(2 * F.col("nb") - 1, F.lit(1))
    exact = lambda c: F.sum(c.cast("decimal(38,12)")).cast("double")
    win = both.withColumn("win_idx", F.floor(F.col("site") / per_window).cast("long")).groupBy("group_a", "group_b", "win_idx").agg(F.count("*").alias("n_sites"), exact(dxy).alias("d"), exact(num).alias("f"))
    return win.select("group_a", "group_b", "win_idx", "n_sites", (F.col("d") / F.col("n_sites")).alias("dxy"), F.when(F.col("d") > 0, F.col("f") / F.col("d")).alias("fst"))


def pair_r2(dosages: DataFrame, reach: int) -> DataFrame:
    """(group_name, site_a, site_b, n, r2) over complete pairs of sites at most reach apart.

    Sites are binned by reach, so a site meets those of its own and the next bin only.
    """
    calls = dosages.filter("dosage >= 0").select("group_name", "sample", "site", F.col("dosage").cast("long").alias("x")).withColumn("bin", F.floor(F.col("site") / reach))
    left = calls.select("group_name", "sample", F.col("site").alias("site_a"), F.col("x").alias("xa"), F.explode(F.array(F.col("bin"), F.col("bin") + 1)).alias("bin"))
    right = calls.select("group_name", "sample", F.col("site").alias("site_b"), F.col("x").alias("xb"), "bin")
    pairs = left.join(right, ["group_name", "sample", "bin"]).filter(f"site_a < site_b and site_b - site_a <= {int(reach)}")
    sums = pairs.groupBy("group_name", "site_a", "site_b").agg(F.count("*").alias("n"), F.sum("xa").alias("a"), F.sum("xb").alias("b"), F.sum(F.col("xa") * F.col("xb")).alias("ab"), F.sum(F.col("xa") * F.col("xa")).alias("aa"), F.sum(F.col("xb") * F.col("xb")).alias("bb"))
    cov = F.col("n") * F.col("ab") - F.col("a") * F.col("b")
    spread = (F.col("n") * F.col("aa") - F.col("a") * F.col("a")) * (F.col("n") * F.col("bb") - F.col("b") * F.col("b"))
    return sums.select("group_name", "site_a", "site_b", "n", F.when(spread > 0, (cov * cov).cast("double") / spread.cast("double")).alias("r2"))


def ld_summary(pairs: DataFrame) -> DataFrame:
    """Per group: pairs, median r2, share above 0.8, and the median of each tenth of distances as decay_1 to decay_10."""
    order = ["_apart", "site_a"]
    dealt = ranges.ranged(pairs.filter("r2 is not null").withColumn("_apart", F.col("site_b") - F.col("site_a")), ["group_name"], order)
    placed = ranges.with_place(dealt, ["group_name"], order, "_place", "_of")
    known = placed.withColumn("tenth", ranges.tile(F.col("_place"), F.col("_of"), 10))
    over = known.groupBy("group_name").agg(F.count("*").alias("n_pairs"), F.percentile("r2", F.lit(0.5)).alias("median_r2"), (F.sum((F.col("r2") > 0.8).cast("int")) / F.count("*")).alias("share_above_08"))
    decay = known.groupBy("group_name").pivot("tenth", list(range(1, 11))).agg(F.percentile("r2", F.lit(0.5)))
    return over.join(decay.select("group_name", *(F.col(str(i)).alias(f"decay_{i}") for i in range(1, 11))), "group_name")


def site_summaries(dosages: DataFrame) -> DataFrame:
    """(group_name, site, n_complete, maf, var): called samples, minor allele frequency and sample variance of the dosages; -1 is not called."""
    x = F.col("dosage").cast("long")
    sums = dosages.filter("dosage >= 0").groupBy("group_name", "site").agg(F.count("*").alias("n_complete"), F.sum(x).alias("x"), F.sum(x * x).alias("xx"))
    p, n = F.col("x") / (2 * F.col("n_complete")), F.col("n_complete")
    return sums.select("group_name", "site", "n_complete", F.least(p, 1 - p).alias("maf"), F.when(n > 1, (n * F.col("xx") - F.col("x") * F.col("x")) / (n * (n - 1))).alias("var"))


def ld_shelf(pairs: DataFrame, start: int, end: int) -> DataFrame:
    """(group_name, median_r2_shelf, median_r2_flank, shelf_ratio): pairs with both sites in start to end against pairs with neither."""
    inside = lambda c: F.col(c).between(start, end)
    of = lambda where, name: F.percentile(F.when(where, F.col("r2")), F.lit(0.5)).alias(name)
    out = pairs.filter("r2 is not null").groupBy("group_name").agg(of(inside("site_a") & inside("site_b"), "median_r2_shelf"), of(~inside("site_a") & ~inside("site_b"), "median_r2_flank"))
    return out.withColumn("shelf_ratio", F.when(F.col("median_r2_flank") > 0, F.col("median_r2_shelf") / F.col("median_r2_flank")))


def expected_heterozygosity(freqs: DataFrame, per_window: int) -> DataFrame:
    """(group_name, win_idx, n_sites, he): the mean over sites of 2pq * 2n / (2n - 1)."""
    n2 = 2 * F.col("n")
    p = F.col("alt") / n2
    he = 2 * p * (1 - p) * n2 / (n2 - 1)
    out = freqs.filter("n >= 1").withColumn("win_idx", F.floor(F.col("site") / per_window).cast("long")).groupBy("group_name", "win_idx").agg(F.count("*").alias("n_sites"), F.sum(he.cast("decimal(38,12)")).cast("double").alias("t"))
    return out.select("group_name", "win_idx", "n_sites", (F.col("t") / F.col("n_sites")).alias("he"))


def pairwise_agreement(calls: DataFrame) -> DataFrame:
    """(source_a, source_b, n, n_agree, share) over (candidate, sample) that both sources call; sources are few, so the pairs of a call are."""
    one = calls.groupBy("candidate", "sample", "source").agg(F.min("call").alias("call"))
    a, b = (one.select("candidate", "sample", F.col("source").alias(f"source_{s}"), F.col("call").alias(f"call_{s}")) for s in "ab")
    both = a.join(b, ["candidate", "sample"]).filter("source_a < source_b")
    out = both.groupBy("source_a", "source_b").agg(F.count("*").alias("n"), F.sum((F.col("call_a") == F.col("call_b")).cast("long")).alias("n_agree"))
    return out.withColumn("share", F.col("n_agree") / F.col("n"))


def round_half_up(x: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d on the double itself."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def contingency(calls_a: DataFrame, calls_b: DataFrame, categories: Sequence[str], least: float = 5.0) -> DataFrame:
    """The joint table of two sets of calls (sample, call, seq), with expected counts and chi-square cells.

    A sample's last call (by seq) counts; samples without both calls drop out; every pair of categories has a row.
    """
    last = lambda df, name: df.groupBy("sample").agg(F.max_by("call", "seq").alias(name))
    both = last(calls_a, "call_a").join(last(calls_b, "call_b"), "sample").filter(F.col("call_a").isin(list(categories)) & F.col("call_b").isin(list(categories)))
    joint = both.groupBy("call_a", "call_b").agg(F.count("*").alias("observed"))
    spark = calls_a.sparkSession
    cells = spark.createDataFrame([(a, b) for a in categories for b in categories], "call_a string, call_b string")
    full = cells.join(joint, ["call_a", "call_b"], "left").na.fill(0, ["observed"])
    total = lambda *by: F.sum("observed").over(Window.partitionBy(*by))  # noqa: E731  over a table of len(categories) squared rows
    expected = total("call_a") * total("call_b") / F.nullif(total(), F.lit(0))
    table = full.withColumn("expected", expected).withColumn("chi_sq", F.when(F.col("expected") > 0, F.pow(F.col("observed") - F.col("expected"), 2) / F.col("expected")).otherwise(0.0))
    return table.select("call_a", "call_b", "observed", round_half_up(F.coalesce("expected", F.lit(0.0)), 2).alias("expected"), round_half_up(F.col("chi_sq"), 3).alias("chi_sq"), (F.coalesce("expected", F.lit(0.0)) >= least).alias("cell_ok"))


def contingency_totals(table: DataFrame) -> DataFrame:
    """n_samples, the total of the rounded cells, degrees of freedom, and cells below the least expectation."""
    return table.agg(F.sum("observed").alias("n_samples"), round_half_up(F.sum(F.col("chi_sq").cast("decimal(38,3)")).cast("double"), 3).alias("total_chi_sq"), ((F.countDistinct("call_a") - 1) * (F.countDistinct("call_b") - 1)).alias("df"), F.sum((~F.col("cell_ok")).cast("int")).cast("long").alias("cells_below_min"))


def mendel_errors(dosages: DataFrame, trios: DataFrame) -> DataFrame:
    """Per trio (offspring, parent1, parent2): sites called in all three, and those that inheritance rules out."""
    call = lambda who: dosages.filter("dosage >= 0").select(F.col("sample").alias(who), "site", F.col("dosage").alias(f"g_{who}"))
    joined = trios.join(call("offspring"), "offspring").join(call("parent1"), ["parent1", "site"]).join(call("parent2"), ["parent2", "site"])
    # a parent gives an allele 0 unless it is 2, and an allele 1 unless it is 0
    low = (F.col("g_parent1") == 2).cast("int") + (F.col("g_parent2") == 2).cast("int")
    high = (F.col("g_parent1") > 0).cast("int") + (F.col("g_parent2") > 0).cast("int")
    wrong = ((F.col("g_offspring") < low) | (F.col("g_offspring") > high)).cast("int")
    sums = joined.groupBy("trio_id", "offspring", "parent1", "parent2").agg(F.count("*").alias("n_sites"), F.sum(wrong).cast("long").alias("n_errors"))
    return sums.withColumn("rate", F.col("n_errors") / F.col("n_sites"))


def king(dosages: DataFrame, pairs: DataFrame | None = None, within: Sequence[str] = ()) -> DataFrame:
    """Per pair of samples: sites called in both, IBS counts, and KING-robust kinship.

    Without pairs (a, b) all come from a site's calls, in the square of its called samples: a panel of samples is bounded, sites are not. They are
    made where they are counted (`_met`). With `within`, columns of dosages, only samples that are equal there are paired, before any pair is made.
    With pairs only theirs are made.
    """
    g = dosages.filter("dosage >= 0")
    by = ["a", "b"]
    if pairs is None:
        both, by = _met(g, ["site", *within])
    else:
        a = g.select("site", F.col("sample").alias("a"), F.col("dosage").alias("x"))
        b = g.select("site", F.col("sample").alias("b"), F.col("dosage").alias("y"))
        both = a.join(pairs.filter("a < b").select("a", "b").distinct(), "a").join(b, ["site", "b"])
    count = lambda c: F.sum(c.cast("int")).cast("long")
    gap = F.abs(F.col("x") - F.col("y"))
    sums = both.groupBy(*by).agg(F.count("*").alias("n_sites"), count(gap == 2).alias("ibs0"), count(gap == 1).alias("ibs1"), count(gap == 0).alias("ibs2"), count((F.col("x") == 1) & (F.col("y") == 1)).alias("both_het"), count(F.col("x") == 1).alias("het_a"), count(F.col("y") == 1).alias("het_b"))
    return sums.select("a", "b", "n_sites", "ibs0", "ibs1", "ibs2", F.when(F.col("het_a") + F.col("het_b") > 0, (F.col("both_het") - 2 * F.col("ibs0")) / (F.col("het_a") + F.col("het_b"))).alias("king"))


def _met(calls: DataFrame, on: list[str]) -> tuple[DataFrame, list[str]]:
    """All pairs (a, x, b, y), a < b, of calls that are equal in on, and the columns that tell pairs apart where they lie.

    What is shuffled are lists of calls and not pairs. Samples in order are cut into blocks of about PAIRS_PER_TASK pairs by their counts; a block gets
    of each site its own calls and those of greater samples, so a list is shared by the block's samples. A sample with more pairs alone is dealt by b
    over parts. Tasks grow in number with the pairs, so that the groups that one task holds don't grow.
    """
    calls = calls.select(*on, "sample", "dosage").dropna(subset=[*on, "sample"])
    n = F.count("*").over(Window.partitionBy(*on))
    # each pair counts for both of its samples, so a block has between none and twice its share as a
    loads = calls.select("sample", (n - 1).alias("_load")).groupBy("sample").agg(F.sum("_load").alias("_load")).filter("_load > 0")
    placed = checkpointed(ranges.with_running(ranges.ranged(loads, [], ["sample"]), [], ["sample"], F.col("_load"), "_upto"))
    met, samples = placed.agg(F.sum("_load") / 2, F.count("*")).first()
    tasks = max(int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((met or 0) / PAIRS_PER_TASK))
    share = 2 * PAIRS_PER_TASK
    whole = Window.partitionBy("_block")
    # the block is named by its first sample
    blocks = placed.withColumn("_block", F.floor((F.col("_upto") - F.col("_load")) / share)).select("sample", F.min("sample").over(whole).alias("_block"), F.greatest(F.floor(F.sum("_load").over(whole) / share), F.lit(1)).alias("_parts"))
    blocks = F.broadcast(blocks) if samples <= BROADCAST_SAMPLES else blocks
    sites = calls.join(blocks, "sample").groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("sample", "dosage", "_block", "_parts"))).alias("_calls"))
    sites = sites.withColumn("_blocks", F.array_distinct("_calls._block"))
    at = sites.select("_calls", "_blocks", F.posexplode("_blocks").alias("_i", "a"))
    # a site's calls from the block's first on, of which the block's own are the first
    place = lambda block: F.array_position("_calls._block", block).cast("int")
    size = F.size("_calls")
    at = at.select("a", place(F.col("a")).alias("_from"), F.coalesce(place(F.get("_blocks", F.col("_i") + 1)), size + 1).alias("_to"), "_calls")
    at = at.select("a", (F.col("_to") - F.col("_from")).alias("_own"), F.get("_calls", F.col("_from") - 1)["_parts"].alias("_parts"), F.slice("_calls", F.col("_from"), size).alias("_calls")).filter(F.size("_calls") > 1)
    here = lambda b: (F.col("_parts") == 1) | (F.pmod(F.xxhash64(b), F.col("_parts")) == F.col("_part"))
    at = at.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    at = at.withColumn("_calls", F.when(F.col("_parts") == 1, F.col("_calls")).otherwise(F.filter("_calls", lambda c, i: (i < F.col("_own")) | here(c["sample"]))))
    lists = at.select("a", "_part", "_parts", "_own", F.col("_calls.sample").alias("_samples"), F.col("_calls.dosage").alias("_dosages")).repartition(tasks, "a", "_part")
    every = lists.select(F.col("a").alias("_block"), "_part", "_parts", "_own", F.arrays_zip("_samples", "_dosages").alias("_calls"))
    a = every.select("_block", "_part", "_parts", "_calls", F.explode(F.slice("_calls", F.lit(1), F.col("_own"))).alias("_a"))
    b = a.select("_block", "_part", "_parts", "_a", F.explode("_calls").alias("_b"))
    both = b.select("_block", "_part", "_parts", F.col("_a._samples").alias("a"), F.col("_a._dosages").alias("x"), F.col("_b._samples").alias("b"), F.col("_b._dosages").alias("y"))
    return both.filter(F.expr("a < b") & here(F.col("b"))), ["_block", "_part", "a", "b"]


def jackknife(rows: DataFrame, value: str, by: str) -> DataFrame:
    """(by, without): the mean of all other groups' rows, from totals and one row a group."""
    groups = rows.groupBy(by).agg(F.sum(F.col(value).cast("decimal(38,9)")).alias("t"), F.count(value).alias("n"))
    whole = groups.agg(F.sum("t").alias("all_t"), F.sum("n").alias("all_n"))
    return groups.join(F.broadcast(whole)).select(by, F.when(F.col("all_n") > F.col("n"), (F.col("all_t") - F.col("t")).cast("double") / (F.col("all_n") - F.col("n"))).alias("without"))


def adjusted_rand(rows: DataFrame, left: str, right: str) -> DataFrame:
    """The adjusted Rand index of two labellings, from their contingency counts."""
    joint = rows.groupBy(left, right).agg(F.count("*").alias("n"))
    pairs = lambda n: (F.col(n) * (F.col(n) - 1) / 2).cast("decimal(38,0)")
    cells = joint.agg(F.sum(pairs("n")).cast("double").alias("ij"), F.sum("n").alias("n"))
    side = lambda c, name: joint.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).cast("double").alias(name))
    one = cells.join(F.broadcast(side(left, "i"))).join(F.broadcast(side(right, "j")))
    expected = F.col("i") * F.col("j") / (F.col("n") * (F.col("n") - 1) / 2)
    return one.select(((F.col("ij") - expected) / ((F.col("i") + F.col("j")) / 2 - expected)).alias("ari"), F.col("n").alias("n"))


def agreement(calls: DataFrame) -> DataFrame:
    """Per (candidate, sample) of (candidate, sample, source, call): sources, distinct calls, whether all agree."""
    return calls.groupBy("candidate", "sample").agg(F.countDistinct("source").alias("n_sources"), F.countDistinct("call").alias("n_calls")).withColumn("agrees", F.col("n_calls") == 1)


def armitage_trend(rows: DataFrame, by: str) -> DataFrame:
    """Cochran-Armitage trend statistic of (dosage 0..2, affected 0/1) per group; null without variance."""
    s = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum("affected").cast("long").alias("r"), F.sum(F.col("dosage") * F.col("affected")).cast("long").alias("rx"), F.sum("dosage").cast("long").alias("x"), F.sum(F.col("dosage") * F.col("dosage")).cast("long").alias("xx"))
    n, r, rx, x, xx = (F.col(c).cast("double") for c in ("n", "r", "rx", "x", "xx"))
    var = r * (n - r) * (n * xx - x * x)
    return s.select(by, "n", "r", F.when(var > 0, (n * rx - r * x) * F.sqrt(n) / F.sqrt(var)).alias("z"))


def odds_ratio(rows: DataFrame, by: str, exposed: str, affected: str) -> DataFrame:
    """The 2 x 2 counts and their odds ratio per group; null with an empty cell in the denominator."""
    count = lambda e, a: F.sum(((F.col(exposed) == e) & (F.col(affected) == a)).cast("int")).cast("long")
    t = rows.groupBy(by).agg(count(1, 1).alias("a"), count(1, 0).alias("b"), count(0, 1).alias("c"), count(0, 0).alias("d"))
    return t.withColumn("odds_ratio", F.when(F.col("b") * F.col("c") > 0, F.col("a") * F.col("d") / (F.col("b") * F.col("c"))))


def pi_by_class(freqs: DataFrame, classes: DataFrame, per_window: int) -> DataFrame:
    """Per window and group: mean pi of sites of class N and of class S, and their ratio; classes is (site, class)."""
    n2 = 2 * F.col("n")
    pi = (2 * F.col("alt") * (n2 - F.col("alt")) / (n2 * (n2 - 1))).cast("decimal(38,12)")
    sites = freqs.join(classes, "site").withColumn("win_idx", F.floor(F.col("site") / per_window).cast("long"))
    mean = lambda c: F.sum(F.when(F.col("class") == c, pi)).cast("double") / F.nullif(F.count(F.when(F.col("class") == c, 1)), F.lit(0))
    out = sites.groupBy("group_name", "win_idx").agg(mean("N").alias("pi_n"), mean("S").alias("pi_s"))
    return out.withColumn("ratio", F.when(F.col("pi_s") > 0, F.col("pi_n") / F.col("pi_s")))


def window_summary(windows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n_windows, mean and maximum of a value over windows."""
    return windows.groupBy(*by).agg(F.count(value).alias("n_windows"), (F.sum(F.col(value).cast("decimal(38,9)")).cast("double") / F.count(value)).alias("mean"), F.max(value).alias("max"))


def dominant_component(long: DataFrame, parts: Sequence[str], least: float) -> DataFrame:
    """Adds group: the part with the greatest share of a row, the first on a tie; null, with fallback set, below least."""
    best = F.greatest(*parts)
    name = F.coalesce(*(F.when(F.col(p) == best, p) for p in parts))
    return long.withColumn("fallback", best < least).withColumn("group", F.when(best >= least, name))


def burden(rows: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Slope, intercept, r2 and the slope's standard error of y on x per group."""
    n = F.regr_count(y, x)
    out = rows.groupBy(by).agg(n.alias("n"), F.regr_slope(y, x).alias("beta"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"))
    error = F.when((F.col("n") > 2) & (F.col("sxx") > 0), F.sqrt(F.greatest(F.lit(0.0), F.col("syy") * (1 - F.col("r2")) / (F.col("n") - 2) / F.col("sxx"))))
    return out.select(by, "n", "beta", "intercept", "r2", error.alias("se"))


def fisher_exact(tables: DataFrame) -> DataFrame:
    """Adds the two-sided p of Fisher's test to (a, b, c, d): the sum over tables that are as likely or less."""

    @F.pandas_udf("double")
    def p_value(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        from math import exp, lgamma

        def tail(log_p, seen, near, end, step):
            """The sum from the first value that is as likely as seen or less to the end; from near on values only become less likely."""
            if log_p(end) > seen:
                return 0.0
            outside, inside = abs(end - near), -1  # distances from near that are in the tail and that aren't
            while outside - inside > 1:
                mid = (outside + inside) // 2
                outside, inside = (mid, inside) if log_p(near + step * mid) <= seen else (outside, mid)
            total = 0.0
            for k in range(near + step * outside, end + step, step):
                term = exp(log_p(k))
                total += term
                if term < total * 1e-18:  # what follows is less still
                    break
            return total

        def one(a, b, c, d):
            r1, r2, c1, n = a + b, c + d, a + c, a + b + c + d
            fixed = lgamma(r1 + 1) + lgamma(r2 + 1) + lgamma(c1 + 1) + lgamma(n - c1 + 1) - lgamma(n + 1)
            log_p = lambda k: fixed - lgamma(k + 1) - lgamma(r1 - k + 1) - lgamma(c1 - k + 1) - lgamma(r2 - c1 + k + 1)
            seen, low, high = log_p(a) + 1e-9, max(0, c1 - r2), min(r1, c1)
            mode = min(max((r1 + 1) * (c1 + 1) // (n + 2), low), high)
            return min(1.0, tail(log_p, seen, mode, low, -1) + (tail(log_p, seen, mode + 1, high, 1) if mode < high else 0.0))

        return pd.Series([one(*map(int, row)) for row in zip(a, b, c, d)])

    return tables.withColumn("p", p_value("a", "b", "c", "d"))


def distance_concordance(calls: DataFrame) -> DataFrame:
    """Per distance of (pair, distance, concordance): mean, pairs above 0.8, pairs that fell by over 0.3 from their shortest distance."""
    first = F.first("concordance").over(Window.partitionBy("pair").orderBy("distance"))
    rows = calls.withColumn("fell", (first - F.col("concordance") > 0.3).cast("int"))
    return rows.groupBy("distance").agg((F.sum(F.col("concordance").cast("decimal(38,9)")).cast("double") / F.count("*")).alias("mean"), F.sum((F.col("concordance") > 0.8).cast("int")).cast("long").alias("above_08"), F.sum("fell").cast("long").alias("decayed"))


def dbscan(points: DataFrame, radius: float, least: int) -> DataFrame:
    """(group_name, id, cluster): density clusters of (group_name, id, x, y); noise has a null cluster.

    Neighbours come from an equi-join on cells of the radius and those around them; clusters are the
    components of core points, and a border point joins the least cluster that reaches it.
    """
    from gridtally.operators.graph import components

    cell = points.withColumn("cx", F.floor(F.col("x") / radius)).withColumn("cy", F.floor(F.col("y") / radius))
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    left = cell.select("group_name", F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy", around.alias("o")).select("group_name", "a", "ax", "ay", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    near = left.join(cell.select("group_name", F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "cx", "cy"), ["group_name", "cx", "cy"]).filter(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2) <= radius * radius).select("group_name", "a", "b")
    core = near.groupBy("group_name", "a").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("a")
    links = near.join(core, "a", "left_semi").join(core.withColumnRenamed("a", "b"), "b", "left_semi")
    roots = components(links.select("a", "b"))
    reach = near.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("least_root"))
    own = points.select("group_name", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").join(reach.withColumnRenamed("a", "id"), "id", "left")
    return own.select("group_name", "id", F.coalesce("root", "least_root").alias("cluster"))
