"""Genotype inputs: likelihood tables, sample lists, sites and their dosages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtally.operators.stats import dosage_code
from gridtally.sources.delimited import lines


def beagle(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """((marker, allele1, allele2, gl array of structs), samples) of a likelihood table with three columns a sample."""
    rows = lines(spark, path).filter(F.trim("line") != "")
    names = rows.orderBy("line_no").first().line.split("\t")[3:]
    if len(names) % 3:
        raise ValueError("the likelihood columns are not in threes")
    samples = []
    for i in range(0, len(names), 3):
        plain = {n[:-3] if n.endswith(("_AA", "_Aa", "_aa")) else n for n in names[i : i + 3]}
        if len(plain) != 1:
            raise ValueError(f"columns {names[i : i + 3]} name different samples")
        samples.append(plain.pop())
    split = F.split("line", "\t")
    value = lambda i: F.get(split, i).try_cast("double")
    gl = F.array(*(F.struct(value(3 + 3 * k).alias("aa"), value(4 + 3 * k).alias("ab"), value(5 + 3 * k).alias("bb")) for k in range(len(samples))))
    return rows.filter("line_no > 0").select(F.get(split, 0).alias("marker"), F.get(split, 1).alias("allele1"), F.get(split, 2).alias("allele2"), gl.alias("gl")), samples


def sample_list(spark: SparkSession, path: str) -> DataFrame:
    """(sample_idx, sample_id) in the file's order: the first cell of each line that is neither blank nor a comment."""
    rows = lines(spark, path).filter((F.trim("line") != "") & ~F.startswith(F.trim("line"), F.lit("#")))
    # a list of samples is small: one file, one task
    listed = rows.select("line_no", F.trim(F.get(F.split("line", "\t"), 0)).alias("sample_id")).agg(F.array_sort(F.collect_list(F.struct("line_no", "sample_id"))).alias("x"))
    return listed.select(F.posexplode("x").alias("sample_idx", "s")).select("sample_idx", "s.sample_id")


def known_and_dropped(ids: list[str], samples: DataFrame) -> DataFrame:
    """(idx, sample_id, known) of the requested ids, in their order."""
    asked = samples.sparkSession.createDataFrame(list(enumerate(ids)), "idx int, sample_id string")
    return asked.join(samples.select("sample_id").distinct().withColumn("_k", F.lit(True)), "sample_id", "left").select("idx", "sample_id", F.coalesce("_k", F.lit(False)).alias("known"))


def sites(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """(site_idx, pos, ref, alt, missingness, diagnostic_score, site_id); a first cell that is no integer makes a header. start and end bound pos, both in.

    site_idx counts data rows only, as the dosage table has its rows in this order.
    """
    split = F.split("line", "\t")
    used = lines(spark, path).filter(F.trim("line") != "")
    data = F.get(split, 0).rlike(r"^\s*\d+\s*$")
    rows = used.filter(data)
    num = lambda i: F.when(~F.upper(F.trim(F.get(split, i))).isin("", ".", "NA"), F.trim(F.get(split, i)).try_cast("double"))
    skipped = used.filter(~data).count()
    placed = rows.select((F.col("line_no") - skipped).cast("long").alias("site_idx"), F.trim(F.get(split, 0)).cast("long").alias("pos"), F.get(split, 1).alias("ref"), F.get(split, 2).alias("alt"), num(3).alias("missingness"), num(4).alias("diagnostic_score"), F.get(split, 5).alias("site_id"))
    return placed.filter((F.col("pos") >= (start if start is not None else 0)) & (F.col("pos") <= (end if end is not None else 2**62)))


def paired(placed: DataFrame, coded: DataFrame) -> DataFrame:
    """Sites beside their dosages, by site_idx; raises if one has rows that the other hasn't."""
    n, m = placed.count(), coded.count()
    if n != m:
        raise ValueError(f"{n} sites, but {m} rows of dosages")
    return placed.join(coded, "site_idx")


def dosage_rows(spark: SparkSession, path: str, n_samples: int) -> DataFrame:
    """(site_idx, dosages) of n_samples codes: longer rows are cut, shorter ones filled with -1."""
    split = F.split("line", "\t")
    rows = lines(spark, path).filter((F.trim("line") != "") & ~F.startswith("line", F.lit("#")))
    head = rows.filter("line_no = 0").filter(F.exists(split, lambda x: ~F.upper(F.trim(x)).isin("0", "1", "2", "-1", "NA", ".", ""))).count()
    coded = F.transform(F.slice(split, 1, n_samples), dosage_code)
    full = F.concat(coded, F.array_repeat(F.lit(-1).cast("tinyint"), n_samples - F.size(coded)))
    return rows.filter(F.col("line_no") >= head).select((F.col("line_no") - head).cast("long").alias("site_idx"), full.alias("dosages"))


def marker_mismatches(markers: DataFrame, placed: DataFrame) -> DataFrame:
    """(idx, marker, expected) where the row's marker isn't chrom_pos of the site at the same place."""
    expected = placed.select("idx", F.concat_ws("_", "chrom", "pos").alias("expected"))
    return markers.join(expected, "idx").filter("marker <> expected")
