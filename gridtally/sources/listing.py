"""Tables of files, and what their paths tell: types, chromosomes, proposals for registries."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, bytes, changed) of the files below a folder, without reading them."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return rows.select("path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"))


def digests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of the files below a folder; each is read as one row, so they should be under 2 GB."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return rows.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def json_files(spark: SparkSession, folder: str, schema: str, recursive: bool = False) -> DataFrame:
    """One row a JSON file of a folder, with its path as _path; files that are no JSON objects drop out, as does a folder that isn't there."""
    try:
        text = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.json").option("wholetext", True).text(folder)
    except AnalysisException:
        return spark.createDataFrame([], f"{schema}, _path string")
    parsed = text.select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"), F.col("_metadata.file_path").alias("_path"))
    return parsed.filter("x is not null and x._bad is null").select("x.*", "_path").drop("_bad")


def chrom_sizes(index: DataFrame) -> DataFrame:
    """(chrom, chrom_size) from the lines of a sequence index."""
    f = F.split("line", "\t")
    return index.filter(F.size(f) >= 2).select(F.get(f, 0).alias("chrom"), F.get(f, 1).try_cast("long").alias("chrom_size"))


def chromosome(name: Column, prefix: str = "C_gar_") -> Column:
    """The chromosome that a name tells: LG28 becomes prefix + LG28, words for all of it become 'global'."""
    token = F.upper(F.regexp_extract(name, r"(?i)(?:^|[._\-/])(LG\d+)(?:[._\-/]|$)", 1))
    return F.when(token != "", F.concat(F.lit(prefix), token)).when(name.rlike(r"(?i)(?:^|[._\-/])(global|genome|wholegenome|all)(?:[._\-/]|$)"), "global")


def inferred_type(path: Column, rules: list[tuple[str, str]]) -> Column:
    """The type of the first rule (pattern, type) that fits the name, else the one that fits its folder."""
    name, parent = F.substring_index(path, "/", -1), F.element_at(F.split(path, "/"), -2)
    of = lambda c: F.coalesce(*(F.when(c.rlike(p), t) for p, t in rules)) if rules else F.lit(None)
    return F.coalesce(of(name), of(F.when(F.size(F.split(path, "/")) > 1, parent)))


def proposals(found: DataFrame, known: DataFrame, rules: list[tuple[str, str]], defaults: DataFrame) -> DataFrame:
    """(path, type, chrom, sample_set_id, problem) for files that no known row names; defaults give a type's sample set."""
    fresh = found.join(known.select("path"), "path", "left_anti").select("path", inferred_type(F.col("path"), rules).alias("type"), chromosome(F.col("path")).alias("chrom"))
    joined = fresh.join(defaults.select("type", "sample_set_id"), "type", "left")
    problem = F.when(F.col("type").isNull(), "unknown type").when(F.col("sample_set_id").isNull(), "no sample set").when(F.col("chrom").isNull(), "no chromosome")
    return joined.select("path", "type", "chrom", "sample_set_id", problem.alias("problem"))


def dosage_manifest(sites: DataFrame, dosages: DataFrame) -> DataFrame:
    """(chrom, last_pos, n_samples) of chromosomes with sites (chrom, pos) and dosages (chrom, n_samples)."""
    last = sites.groupBy("chrom").agg(F.max("pos").alias("last_pos"))
    return last.join(dosages.groupBy("chrom").agg(F.max("n_samples").alias("n_samples")), "chrom")


def preferred(found: DataFrame, key: str, exact: Column, avoid: str) -> DataFrame:
    """One path a key: the exact name, else the first without the avoided word, else the first."""
    w = Window.partitionBy(key).orderBy(~exact, F.contains(F.lower("path"), F.lit(avoid)), "path")
    return found.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def changed_since(found: DataFrame, built: DataFrame) -> DataFrame:
    """Sources (path, changed) newer than what was built of them (path, built_at), or never built."""
    return found.join(built, "path", "left").filter(F.col("built_at").isNull() | (F.col("changed") > F.col("built_at"))).select("path")
