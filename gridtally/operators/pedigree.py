"""Parents of samples from kinship and genotypes.

Parent and offspring are first-degree relatives without opposite homozygotes. Of a sample's first-degree neighbours two can only be
its parents if they aren't related to each other; its offspring are, to each other and to its parents. So
each neighbour counts its relatives among the others, by joins on the pairs that kinship lists (from a pair's end of fewer
neighbours), and only those that lack one are paired: no triples of a large family are made. What Mendel's rules exclude then scores
the trios; that also tells parents from offspring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtally.operators.graph import components
from gridtally.operators.stats import mendel_errors
from gridtally.session import checkpointed

#: Kinship of first-degree relatives, and from where two samples count as related: powers of two between the degrees.
FIRST = (2**-2.5, 2**-1.5)
RELATED = 2**-3.5


def neighbours(kin: DataFrame, most_ibs0: float) -> DataFrame:
    """(c, p), both ways: pairs that may be parent and offspring, from (a, b, n_sites, ibs0, king)."""
    close = kin.filter(F.col("king").between(*FIRST) & (F.col("ibs0") <= most_ibs0 * F.col("n_sites"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    return close.select(F.col("a").alias("c"), F.col("b").alias("p")).union(close.select("b", "a"))


def candidate_trios(kin: DataFrame, most_ibs0: float = 0.005) -> DataFrame:
    """(offspring, parent1, parent2), parent1 < parent2: pairs of a sample's neighbours that kinship doesn't list as related."""
    edges = checkpointed(neighbours(kin, most_ibs0))
    degree = edges.groupBy("c").agg(F.count("*").alias("degree"))
    related = kin.filter(F.col("king") >= RELATED).select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).filter("p <> q").distinct()
    sized = related.join(degree.select(F.col("c").alias("p"), F.col("degree").alias("dp")), "p").join(degree.select(F.col("c").alias("q"), F.col("degree").alias("dq")), "q")
    # every pair of relatives with a common neighbour: from the end of fewer neighbours, then a look-up at the other
    fewer = F.col("dp") <= F.col("dq")
    ends = sized.select(F.when(fewer, F.col("p")).otherwise(F.col("q")).alias("near"), F.when(fewer, F.col("q")).otherwise(F.col("p")).alias("far"))
    common = ends.join(edges.select("c", F.col("p").alias("near")), "near").join(edges.select("c", F.col("p").alias("far")), ["c", "far"])
    known = checkpointed(common.select("c", F.col("near").alias("p"), F.col("far").alias("q")))
    relatives = known.select("c", "p").union(known.select("c", "q")).groupBy("c", "p").agg(F.count("*").alias("relatives"))
    lone = edges.join(degree, "c").join(relatives, ["c", "p"], "left").filter(F.coalesce("relatives", F.lit(0)) < F.col("degree") - 1).select("c", "p")
    lone = checkpointed(lone)
    pairs = lone.join(lone.withColumnRenamed("p", "q"), "c").filter("p < q")
    both = known.select("c", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
    return pairs.join(both, ["c", "p", "q"], "left_anti").select(F.col("c").alias("offspring"), F.col("p").alias("parent1"), F.col("q").alias("parent2"))


def pedigree(kin: DataFrame, dosages, most_errors: float = 0.01, most_ibs0: float = 0.005, errors: Callable = mendel_errors) -> DataFrame:
    """(offspring, parent1, parent2, n_sites, n_errors, family): each sample's best pair of parents, where one is good enough.

    Of a sample's trios the one with the least share of errors counts (then of the least parents), if it is at most most_errors. A trio falls if
    another one has one of its edges the other way round with a lesser share. family is the least sample of a family's. errors scores trios on
    dosages: by a row a call, or by packed.mendel_errors on bitmaps.
    """
    trios = candidate_trios(kin, most_ibs0)
    trios = trios.withColumn("trio_id", F.struct("offspring", "parent1", "parent2"))
    scored = errors(dosages, trios).filter(F.col("rate") <= most_errors)
    best = scored.groupBy("offspring").agg(F.min(F.struct("rate", "parent1", "parent2", "n_sites", "n_errors")).alias("t")).select("offspring", "t.*")
    best = checkpointed(best)
    edges = best.select("offspring", F.explode(F.array("parent1", "parent2")).alias("parent"), "rate")
    turned = edges.select(F.col("parent").alias("offspring"), F.col("offspring").alias("parent"), F.col("rate").alias("other"))
    beaten = edges.join(turned, ["offspring", "parent"]).filter((F.col("other") < F.col("rate")) | ((F.col("other") == F.col("rate")) & (F.col("parent") < F.col("offspring")))).select("offspring")
    kept = checkpointed(best.join(beaten.distinct(), "offspring", "left_anti"))
    links = kept.select(F.col("offspring").alias("a"), F.explode(F.array("parent1", "parent2")).alias("b"))
    families = components(links).select(F.col("node").alias("offspring"), F.col("root").alias("family"))
    return kept.join(families, "offspring", "left").select("offspring", "parent1", "parent2", "n_sites", "n_errors", F.coalesce("family", "offspring").alias("family"))
