"""Windows over ordered rows of a key without one task a key.

Rows are dealt by ranges of key and order, so a key with very many rows lies in many ranges. What a window needs from before a
range comes from one row a key and range: the last row, or a sum. Keys may be null; the order must tell the rows of a key
apart, or they count as equal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtally.session import checkpointed

RANGE = "_range"


def ranged(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows with the number of their range; written, as the ranges are drawn from a sample."""
    return checkpointed(rows.repartitionByRange(*keys, *order).withColumn(RANGE, F.spark_partition_id()))


def _inside(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, RANGE).orderBy(*order)


def _joined(rows: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with carried's columns for the same keys, null being equal to null, and range."""
    other = carried.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, RANGE])), *(c for c in carried.columns if c not in (*keys, RANGE)))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, RANGE])]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return rows.join(other, condition).drop(*(f"_k{i}" for i in range(len(same))))


def with_previous(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds a struct (v) of the value in the row before, null in a key's first row."""
    whole = F.struct(value.alias("v"))
    last = rows.groupBy(*keys, RANGE).agg(F.max_by(whole, F.struct(*order)).alias("_last"))
    carried = last.select(*keys, RANGE, F.lag("_last").over(Window.partitionBy(*keys).orderBy(RANGE)).alias("_ahead_of_range"))
    out = _joined(rows.withColumn("_in_range", F.lag(whole).over(_inside(keys, order))), carried, keys)
    return out.withColumn(name, F.coalesce("_in_range", "_ahead_of_range")).drop("_in_range", "_ahead_of_range")


def with_running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of the value over the rows up to this one."""
    sums = rows.groupBy(*keys, RANGE).agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("_in_range", F.sum(value).over(_inside(keys, order).rowsBetween(Window.unboundedPreceding, 0)))
    return _joined(out, sums.select(*keys, RANGE, before.alias("_ahead_of_range")), keys).withColumn(name, F.col("_in_range") + F.col("_ahead_of_range")).drop("_in_range", "_ahead_of_range")


def with_greatest_before(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds the greatest value over the rows before this one, null in a key's first row."""
    most = rows.groupBy(*keys, RANGE).agg(F.max(value).alias("_most"))
    before = F.max("_most").over(Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("_in_range", F.max(value).over(_inside(keys, order).rowsBetween(Window.unboundedPreceding, -1)))
    return _joined(out, most.select(*keys, RANGE, before.alias("_ahead_of_range")), keys).withColumn(name, F.greatest("_in_range", "_ahead_of_range")).drop("_in_range", "_ahead_of_range")


def with_place(rows: DataFrame, keys: Sequence[str], order: Sequence[str], place: str, of: str) -> DataFrame:
    """Adds a row's place in its key, from 1, and the key's rows."""
    counts = rows.groupBy(*keys, RANGE).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*keys)
    before = F.sum("_n").over(whole.orderBy(RANGE)) - F.col("_n")
    out = rows.withColumn("_in_range", F.row_number().over(_inside(keys, order)))
    return _joined(out, counts.select(*keys, RANGE, before.alias("_ahead_of_range"), F.sum("_n").over(whole).alias(of)), keys).withColumn(place, F.col("_in_range") + F.col("_ahead_of_range")).drop("_in_range", "_ahead_of_range")


def tile(place: Column, of: Column, tiles: int) -> Column:
    """The tile, from 1, of a place among `of` rows: as even as can be, the larger tiles first."""
    size, larger = F.floor(of / tiles), of % tiles
    edge = larger * (size + 1)
    return F.when(place <= edge, F.ceil(place / (size + 1))).otherwise(larger + F.ceil((place - edge) / F.greatest(size, F.lit(1)))).cast("int")
