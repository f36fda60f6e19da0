"""VCF and BED text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vcf_sites(rows: DataFrame) -> DataFrame:
    """(chrom, pos, id, ref, alts, filter, info map) from VCF lines; headers drop out."""
    f = F.split("line", "\t")
    info = F.map_from_entries(F.transform(F.filter(F.split(F.get(f, 7), ";"), lambda x: (x != "") & (x != ".")), lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.when(F.contains(x, F.lit("=")), F.substring(x, F.instr(x, "=") + 1, F.length(x))).otherwise("true").alias("value"))))
    used = rows.filter(~F.startswith("line", F.lit("#")) & (F.size(f) >= 8))
    return used.select(F.get(f, 0).alias("chrom"), F.get(f, 1).try_cast("long").alias("pos"), F.get(f, 2).alias("id"), F.get(f, 3).alias("ref"), F.split(F.get(f, 4), ",").alias("alts"), F.get(f, 6).alias("filter"), info.alias("info"))


def vcf_dosages(rows: DataFrame, samples: list[str]) -> DataFrame:
    """(chrom, pos, sample, dosage) with the number of alternative alleles of each call; -1 where one is missing."""
    f = F.split("line", "\t")
    used = rows.filter(~F.startswith("line", F.lit("#")) & (F.size(f) >= 9 + len(samples)))
    calls = F.arrays_zip(F.array(*map(F.lit, samples)).alias("sample"), F.slice(f, 10, len(samples)).alias("cell"))
    each = used.select(F.get(f, 0).alias("chrom"), F.get(f, 1).try_cast("long").alias("pos"), F.explode(calls).alias("c"))
    alleles = F.split(F.substring_index(F.col("c.cell"), ":", 1), r"[/|]")
    dosage = F.when(F.exists(alleles, lambda a: a == "."), -1).otherwise(F.size(F.filter(alleles, lambda a: a != "0")))
    return each.select("chrom", "pos", F.col("c.sample").alias("sample"), dosage.cast("int").alias("dosage"))


def bed_intervals(rows: DataFrame) -> DataFrame:
    """(chrom, start, end, name) from BED lines, 1-based with both ends in."""
    f = F.split("line", r"\s+")
    used = rows.filter(~F.col("line").rlike("^(#|track|browser)") & (F.size(f) >= 3))
    return used.select(F.get(f, 0).alias("chrom"), (F.get(f, 1).try_cast("long") + 1).alias("start"), F.get(f, 2).try_cast("long").alias("end"), F.get(f, 3).alias("name"))
