"""Sampling and thinning of sorted sites.

Work over a chromosome's order goes through bins of WIDTH positions: a place or a neighbour is found
within the bin, and what lies before or behind it comes from one row a bin. So a chromosome is many
tasks, and only the rows of its bins meet in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtally.session import checkpointed

WIDTH = 1 << 14
_BEFORE = (Window.unboundedPreceding, -1)


def _bin(width: int) -> Column:
    return F.floor(F.col("pos") / width).cast("long")


def numbered(sites: DataFrame, width: int = WIDTH) -> DataFrame:
    """sites with idx, their place in their chromosome from 0 in order of pos and site_id, and n, the chromosome's sites."""
    binned = sites.withColumn("_bin", _bin(width))
    counts = binned.groupBy("chrom", "_bin").agg(F.count("*").alias("_n"))
    own = Window.partitionBy("chrom")
    before = F.coalesce(F.sum("_n").over(own.orderBy("_bin").rowsBetween(*_BEFORE)), F.lit(0))
    offsets = counts.select("chrom", "_bin", before.alias("_before"), F.sum("_n").over(own).alias("n"))
    place = F.row_number().over(Window.partitionBy("chrom", "_bin").orderBy("pos", "site_id")) - 1
    return binned.withColumn("_place", place).join(offsets, ["chrom", "_bin"]).withColumn("idx", F.col("_before") + F.col("_place")).drop("_bin", "_before", "_place")


def beside(points: DataFrame, sites: DataFrame, below_first: Column, above_first: Column, width: int = WIDTH) -> DataFrame:
    """points with below and above, as structs (pos, site): the last site at or before each point, the first at or behind it.

    sites has chrom, pos and site; of sites at one place below is that of the greatest below_first, above of the least above_first.
    """
    s = sites.select("chrom", _bin(width).alias("_bin"), "pos", F.struct("pos", "site").alias("_site"), below_first.alias("_low"), above_first.alias("_high"))
    p = points.select("chrom", _bin(width).alias("_bin"), "pos", F.struct(*points.columns).alias("_point"))
    line = s.unionByName(p, allowMissingColumns=True)
    own = Window.partitionBy("chrom", "_bin")
    at_point = F.col("_point").isNotNull()  # sites come before a point at their place, in either direction
    up, down = own.orderBy("pos", at_point, "_low"), own.orderBy(F.desc("pos"), at_point, F.desc("_high"))
    near = line.withColumn("_below", F.last("_site", True).over(up)).withColumn("_above", F.last("_site", True).over(down)).filter(at_point)
    ends = s.groupBy("chrom", "_bin").agg(F.max_by("_site", F.struct("pos", "_low")).alias("_last"), F.min_by("_site", F.struct("pos", "_high")).alias("_first"))
    bins = ends.unionByName(p.select("chrom", "_bin").distinct(), allowMissingColumns=True).groupBy("chrom", "_bin").agg(F.max("_last").alias("_last"), F.max("_first").alias("_first"))
    line = Window.partitionBy("chrom")
    before = F.last("_last", True).over(line.orderBy("_bin").rowsBetween(*_BEFORE))
    behind = F.last("_first", True).over(line.orderBy(F.desc("_bin")).rowsBetween(*_BEFORE))
    carried = bins.select("chrom", "_bin", before.alias("_before"), behind.alias("_behind"))
    out = near.join(carried, ["chrom", "_bin"])
    return out.select("_point.*", F.coalesce("_below", "_before").alias("below"), F.coalesce("_above", "_behind").alias("above"))


def _nearer() -> Column:
    """The site of below or above, whichever is nearer to pos; the lower on a tie."""
    low = F.col("above").isNull() | (F.col("below").isNotNull() & (F.col("pos") - F.col("below.pos") <= F.col("above.pos") - F.col("pos")))
    return F.when(low, F.col("below.site")).otherwise(F.col("above.site"))


def nearest(points: DataFrame, sites: DataFrame, width: int = WIDTH) -> DataFrame:
    """(point_id, site_id): for each point its nearest site, the lower on a tie, the lesser site_id at one place."""
    both = beside(points.select("chrom", "pos", "point_id"), sites.select("chrom", "pos", F.col("site_id").alias("site")), -F.col("site"), F.col("site"), width)
    return both.select("point_id", _nearer().alias("site_id"))


def even_sample(sites: DataFrame, cap: int, width: int = WIDTH) -> DataFrame:
    """(chrom, idx): cap sites of each chromosome, spread evenly by position.

    The span is cut into cap bins; each bin's midpoint takes the nearest site, the lower on a tie; a
    pick that equals the one before moves up by one. Sites are numbered from 0 in order of pos. The
    rule on equal picks looks at final picks, so it is a fold over the cap picks of a chromosome.
    """
    placed = numbered(sites.select("chrom", "pos", "site_id"), width)
    few = placed.filter(F.col("n") <= cap).select("chrom", "idx")
    many = placed.filter(F.col("n") > cap)
    spans = many.groupBy("chrom").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.max("n").alias("n"))
    targets = spans.select("chrom", "n", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))).alias("t")).select("chrom", "n", "t", (F.col("lo") + (F.col("hi") - F.col("lo")) * (2 * F.col("t") + 1) / (2 * cap)).alias("pos"))
    both = beside(targets, many.select("chrom", F.col("pos").cast("double").alias("pos"), F.col("idx").alias("site")), F.col("site"), F.col("site"), width)
    picks = both.select("chrom", "n", "t", _nearer().alias("pick"))
    ordered = picks.groupBy("chrom", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "pick"))), lambda x: x["pick"]).alias("picks"))  # cap of them
    step = lambda acc, x: F.concat(acc, F.array(F.when((F.size(acc) > 0) & (F.element_at(acc, -1) == x), F.least(x + 1, F.col("n") - 1)).otherwise(x)))
    final = ordered.select("chrom", F.explode(F.array_distinct(F.aggregate("picks", F.array().cast("array<bigint>"), step))).alias("idx"))
    return few.unionByName(final)


def chunk(sites: DataFrame, cap: int, mode: str = "raw") -> tuple[DataFrame, str | None]:
    """(chrom, idx) of the sites of a request, and what to tell of it: all of them, or cap of them evenly where there are more."""
    n = sites.count()
    if n == 0:
        return numbered(sites).select("chrom", "idx"), "no sites in region"
    if n <= cap:
        return numbered(sites).select("chrom", "idx"), None
    told = f"even mode: at most {cap} sites picked from {n}" if mode == "even" else f"raw_cap_exceeded auto-switched to mode=even: at most {cap} sites picked from {n}"
    return even_sample(sites, cap), told


def thin_greedy(sites: DataFrame, least_distance: int, width: int = WIDTH) -> DataFrame:
    """Sites of which each lies at least least_distance behind the one kept before it, by chromosome.

    Each choice depends on the one before, so every place points to its successor, the first place that
    may be kept after it; the places reached from a chromosome's first one are found by doubling: pointers over
    1, 2, 4 and so on steps, then from the longest on what the places reached so far point to. Rounds
    are logarithmic in the sites kept, and no chromosome is gathered. Of sites at one place the least site_id is kept.
    """
    if least_distance <= 0:
        return sites.select("chrom", "pos", "site_id")
    places = checkpointed(sites.groupBy("chrom", "pos").agg(F.min("site_id").alias("site_id")))
    asked = places.select("chrom", (F.col("pos") + least_distance).alias("pos"), F.col("pos").alias("at"))
    found = beside(asked, places.select("chrom", "pos", F.col("pos").alias("site")), F.col("site"), F.col("site"), width)
    jumps = [checkpointed(found.filter("above is not null").select("chrom", F.col("at").alias("pos"), F.col("above.pos").alias("next")))]
    while True:
        over = jumps[-1].select("chrom", F.col("pos").alias("next"), F.col("next").alias("far"))
        longer = checkpointed(jumps[-1].join(over, ["chrom", "next"]).select("chrom", "pos", F.col("far").alias("next")))
        if longer.isEmpty():
            break
        jumps.append(longer)
    reached = places.groupBy("chrom").agg(F.min("pos").alias("pos"))
    for jump in reversed(jumps):
        reached = checkpointed(reached.union(reached.join(jump, ["chrom", "pos"]).select("chrom", F.col("next").alias("pos"))))
    return reached.join(places, ["chrom", "pos"]).select("chrom", "pos", "site_id")


def thin_random(sites: DataFrame, width: int, seed: int) -> DataFrame:
    """One site of each bin of width, that of the least digest of its id and the seed."""
    digest: Column = F.md5(F.concat_ws(":", F.col("site_id").cast("string"), F.lit(str(seed))))
    return sites.groupBy("chrom", F.floor(F.col("pos") / width).cast("long").alias("bin")).agg(F.min_by("site_id", F.struct(digest, "site_id")).alias("site_id"))


def windows_of_sites(sites: DataFrame, per_window: int) -> DataFrame:
    """(chrom, window, start, end, n): consecutive windows of per_window sites."""
    window = F.floor(F.col("idx") / per_window).cast("long")
    return numbered(sites.select("chrom", "pos", "site_id")).groupBy("chrom", window.alias("window")).agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("n"))


def thin_to(sites: DataFrame, most: int) -> DataFrame:
    """At most `most` sites of each chromosome, evenly by number."""
    chosen = (F.col("n") <= most) | (F.floor(F.col("idx") * most / F.col("n")) != F.floor((F.col("idx") - 1) * most / F.col("n")))
    return numbered(sites).filter(chosen).drop("idx", "n")
