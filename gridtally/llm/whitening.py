"""Operator 11: whitening of embeddings by their principal components.

Entries become whole numbers x = floor(SCALE * c) + SHIFT, and the model is fitted on every distinct vector
once. Sums are exact (decimals), n * x - S is formed in whole numbers, and rows are centred by one division,
so no large mean is ever squared. The covariance is MLlib's RowMatrix.computeGramianMatrix over the centred
rows, divided by n; its eigenvectors are found on the driver, where only a matrix of the dimension's square
lies, and are broadcast to the tasks that whiten, batch by batch. Copies meet in a partial aggregation before they are shuffled.

Defined cases: a null or empty vector, one with a null, NaN or infinite entry, one with an entry beyond
LARGEST (whose scaled value a double doesn't hold exactly), and one whose length isn't the commonest are left out.
Repeated rows each get their rows; a null id stays null; further columns stay in `transform` and out of
`components`. Components whose eigenvalue is 0 to double precision can't be whitened and are left out, so a single
distinct vector, or an empty table, gives no rows. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtally.llm.texts import fresh
from gridtally.llm.vectors import common_size, finite
from gridtally.session import checkpointed

SCALE, SHIFT = 64, 1_000_000
#: Scaled entries beyond this aren't whole numbers that a double holds exactly.
LARGEST = float(2**53 - SHIFT)


def whole(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows whose vector can be used, with its entries as longs in `name`."""
    rows = rows.withColumn(name, F.col(column).cast("array<double>"))
    fits = F.forall(name, lambda c: F.abs(c * SCALE) <= LARGEST)
    rows = rows.filter(finite(name)).filter(fits)
    return rows.withColumn(name, F.transform(name, lambda c: F.floor(c * SCALE).cast("long") + SHIFT))


def numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S in whole numbers: 64 bits where they suffice for the squares' sum too, else Python's."""
    base = np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    off = x - base
    most = (int(np.abs(off).max(initial=0)) + 1) * n
    if most * most * len(sums) < 2**62:
        return off * n - np.array(rest, np.int64)
    return off.astype(object) * n - np.array(rest, object)


def squares(num: np.ndarray) -> list[int | None]:
    """Sums of squares along a row; None beyond 64 bits."""
    return [int(s) if s < 2**63 else None for s in (num * num).sum(axis=1)]


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def _gramian(rows: DataFrame, column: str, count: int) -> np.ndarray:
    """The sum of outer products of an array column's rows, divided by count."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray() / count


def _mapped(rows: DataFrame, column: str, name: str, of) -> DataFrame:
    """One array<double> column: `of` (a matrix of whole numbers to one of doubles) of an array<long> column."""

    def task(batches):
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({name: list(of(_stacked(batch[column])))})

    return rows.select(column).mapInPandas(task, T.StructType([T.StructField(name, T.ArrayType(T.DoubleType()))]))


@dataclass
class Whitening:
    """A fitted model; `vectors` has a component a column, in the order of falling eigenvalues."""

    dimension: int
    n: int = 0
    sums: list[int] = field(default_factory=list)
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    trace: float = 0.0
    identity_error: float = 0.0

    def project(self, num: np.ndarray) -> np.ndarray:
        """Whitened values of rows given as numerators."""
        return (num / self.n).astype(float) @ self.vectors / np.sqrt(self.values)

    def transform(self, rows: DataFrame, column: str = "embedding") -> DataFrame:
        """rows that can be whitened, all columns as they are, then `deviation` and the array `whitened` (names as free)."""
        names = [fresh(rows.columns, n) for n in ("x", "deviation", "whitened")]
        x, deviation, whitened = names
        kept = whole(rows, column, x).filter(F.size(x) == self.dimension)
        model = rows.sparkSession.sparkContext.broadcast(self)

        def task(batches):
            m = model.value
            for batch in batches:
                if len(batch):
                    num = numerators(_stacked(batch[x]), m.n, m.sums)
                    yield batch.drop(columns=x).assign(**{deviation: pd.array(squares(num), "Int64"), whitened: list(m.project(num))})

        added = [T.StructField(deviation, T.LongType()), T.StructField(whitened, T.ArrayType(T.DoubleType()))]
        return kept.mapInPandas(task, T.StructType([*rows.schema.fields, *added]))


def fit(rows: DataFrame, column: str = "embedding", most: int = 16) -> Whitening:
    """The model of at most `most` components over the distinct vectors of rows."""
    x = whole(rows.select(column), column, "x").select("x")
    d = common_size(x, "x")
    if d == 0:
        return Whitening(0)
    distinct = checkpointed(x.filter(F.size("x") == d).groupBy("x").agg(F.lit(1).alias("one")).select("x"))
    each = distinct.select(F.posexplode("x").alias("at", "value"))
    sums = each.groupBy("at").agg(F.sum(F.col("value").cast("decimal(19,0)")).alias("s"), F.count("*").alias("n")).orderBy("at").collect()
    model = Whitening(d, sums[0].n, [int(r.s) for r in sums])

    centred = _mapped(distinct, "x", "c", lambda v, n=model.n, s=model.sums: (numerators(v, n, s) / n).astype(float))
    covariance = _gramian(centred, "c", model.n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")
    kept = [i for i in order[:most] if values[i] > d * np.finfo(float).eps * max(values.max(), 0)]
    model.trace = float(np.trace(covariance))
    model.values, model.vectors = values[kept], vectors[:, kept]
    if kept:
        model.identity_error = _identity_error(distinct, model)
    return model


def _identity_error(distinct: DataFrame, model: Whitening) -> float:
    """The largest entry of whitened's covariance minus the identity, measured on the fit list."""
    plain = lambda v: model.project(numerators(v, model.n, model.sums))
    white = _mapped(distinct, "x", "w", plain).select(F.posexplode("w").alias("at", "value"))
    mean = np.array([r.m for r in white.groupBy("at").agg(F.avg("value").alias("m")).orderBy("at").collect()])
    covariance = _gramian(_mapped(distinct, "x", "w", lambda v: plain(v) - mean), "w", model.n)
    return float(np.abs(covariance - np.eye(len(mean))).max())


def components(rows: DataFrame, column: str = "embedding", most: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each row of rows and component."""
    model = fit(rows, column, most)
    out = model.transform(rows.select("vec_id", column), column)
    share = F.lit([float(v / model.trace) for v in model.values]).cast("array<double>")
    each = out.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
