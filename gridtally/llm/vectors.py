"""Rows whose vectors operators can use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(column: str) -> Column:
    """True for a vector with entries of which none is null, NaN or infinite; never null."""
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce((F.size(column) > 0) & ~bad, F.lit(False))


def common_size(rows: DataFrame, column: str) -> int:
    """The number of entries that most vectors have; of equally frequent ones the greatest; 0 without rows."""
    sizes = rows.groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).head()
    return sizes.d if sizes else 0
