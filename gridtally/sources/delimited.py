"""Delimited text, JSON lines and their coercion rules."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Cells that stand for nothing, in numeric columns only.
MISSING = ("", "NA", "NaN")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of text files; .gz is read as it is. Numbers follow each file's order, from 0.

    Files are read in splits, many tasks a file. Rows of a split have rising ids without gaps, so a line's number is
    its place in the split behind the lines of the file's splits before it; only one row a split is shuffled.
    """
    block = F.col("_metadata.file_block_start")
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), block.alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    splits = rows.groupBy("path", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = splits.select("path", "_block", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.join(starts, ["path", "_block"]).select("path", (F.col("_id") + F.col("_shift")).alias("line_no"), "line")


def number(cell: Column) -> Column:
    """A cell as a double: decimal, exponent or hex form, blanks as 0; null for anything else, infinities too."""
    t = F.trim(cell)
    hexed = F.conv(F.substring(t, 3, 32), 16, 10).try_cast("double")
    plain = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
    value = F.when(t == "", F.lit(0.0)).when(t.rlike("^0[xX][0-9a-fA-F]+$"), hexed).otherwise(plain)
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def cells(rows: DataFrame, sep: str, names: list[str]) -> DataFrame:
    """One string column a name from the lines; comments and blank lines drop out, short lines give ''."""
    used = rows.filter(~F.startswith("line", F.lit("#")) & (F.trim("line") != ""))
    split = F.split("line", sep)
    return used.select("line_no", *(F.coalesce(F.get(split, i), F.lit("")).alias(n) for i, n in enumerate(names)))


def header(rows: DataFrame, sep: str) -> list[str]:
    """The names in the first line that is neither blank nor a comment."""
    first = rows.filter(~F.startswith("line", F.lit("#")) & (F.trim("line") != "")).orderBy("line_no").limit(1).collect()
    return first[0].line.split(sep) if first else []


def coerced(frame: DataFrame, names: list[str]) -> DataFrame:
    """Columns whose every cell that isn't missing is a number become doubles; the others stay as they are."""
    blank = lambda n: F.col(n).isin(*MISSING)
    tests = [F.coalesce(F.bool_and(blank(n) | number(F.col(n)).isNotNull()), F.lit(True)).alias(n) for n in names]
    numeric = frame.agg(*tests).first()
    return frame.select(*(c for c in frame.columns if c not in names), *((F.when(~blank(n), number(F.col(n))) if numeric[n] else F.col(n)).alias(n) for n in names))


def parse_delimited(spark: SparkSession, path: str, sep: str = "\t", has_header: bool = True, fields: list[str] | None = None) -> DataFrame:
    """A delimited file as typed columns; fields keeps those of the names that exist."""
    rows = lines(spark, path)
    names = header(rows, sep)
    if has_header:
        first = rows.filter(~F.startswith("line", F.lit("#")) & (F.trim("line") != "")).agg(F.min("line_no")).first()[0]
        rows = rows.filter(F.col("line_no") > (first if first is not None else -1))
    else:
        names = [f"col_{i}" for i in range(len(names))]
    chosen = names if fields is None else [n for n in names if n in fields]
    return coerced(cells(rows, sep, names).select("line_no", *chosen), chosen).drop("line_no")


def strings(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """All cells as strings, missing ones as ''; comments are lines like any other."""
    rows = lines(spark, path).filter(F.col("line") != "")
    names = rows.orderBy("line_no").first().line.split(sep)
    split = F.split("line", sep)
    return rows.filter(F.col("line_no") > 0).select(*(F.coalesce(F.get(split, i), F.lit("")).alias(n) for i, n in enumerate(names)))


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; strict fails on a bad one and has no rows where there is no file, else a bad one stays as text in _raw."""
    if strict:
        try:
            return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, _raw string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_raw").json(path)


def numbered_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with _line, from 1 in each file; a bad one has its text in _raw and what is wrong in _error. Blank lines drop out."""
    rows = lines(spark, path).filter(F.trim("line") != "")
    parsed = F.from_json(F.trim("line"), f"{schema}, _raw string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_raw"})
    read = rows.select(parsed.alias("x"), (F.col("line_no") + 1).alias("_line"), "line")
    return read.select("x.*", "_line", "line").withColumns({"_error": F.when(F.col("_raw").isNotNull(), "not a JSON object"), "_raw": F.when(F.col("_raw").isNotNull(), F.col("line"))}).drop("line")


def window_stats(rows: DataFrame, names: list[str]) -> DataFrame:
    """A statistics table: lines of another width drop out; counts are integers, names strings, the rest finite doubles or null."""
    whole = {"start", "end", "n_sites", "n_sites_used", "S"}
    split = F.split("line", "\t")
    used = rows.filter(~F.startswith("line", F.lit("#")) & (F.size(split) == len(names)) & (F.get(split, 0) != names[0]))

    def typed(i: int, name: str) -> Column:
        cell = F.get(split, i)
        if name in ("window_id", "chrom"):
            return cell
        if name in whole:
            return F.trim(cell).try_cast("bigint")
        value = F.trim(cell).try_cast("double")
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)

    return used.select(*(typed(i, n).alias(n) for i, n in enumerate(names)))


def by_synonym(frame: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """One column for each name, from the first of its synonyms that is there, whatever its case; absent ones are null."""
    have = {c.lower(): c for c in frame.columns}
    pick = lambda options: next((have[o.lower()] for o in options if o.lower() in have), None)
    return frame.select(*((F.col(c) if (c := pick(options)) else F.lit(None)).alias(name) for name, options in synonyms.items()))
