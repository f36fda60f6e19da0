"""Tail probabilities of the normal, t and chi-square distributions as Column expressions.

Series and continued fractions are folds of Spark's own functions over a row, so nothing leaves the JVM. A fold's length follows the
parameters (it grows with the square root of the degrees of freedom) and its terms stop changing once they have converged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos' approximation of the logarithm of the gamma function for g = 7; fixed values.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]
LANCZOS_G = 7
SMALL, CLOSE = 1e-300, 1e-16


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x of at least 0.5."""
    z = x - 1
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (z + i)
    t = z + LANCZOS_G + 0.5
    return 0.9189385332046727 + (z + 0.5) * F.ln(t) - t + F.ln(series)


def _steps(size: Column) -> Column:
    return F.sequence(F.lit(1), (F.lit(100) + F.ceil(8 * F.sqrt(size))).cast("int"))


def _away(x: Column) -> Column:
    """x, or a tiny number where it is 0."""
    return F.when(F.abs(x) < SMALL, F.lit(SMALL)).otherwise(x)


def gamma_tail(a: Column, x: Column) -> Column:
    """Q(a, x), the regularised upper incomplete gamma function: the series below a + 1, the continued fraction from there."""
    front = F.exp(a * F.ln(x) - x - log_gamma(a))
    start = F.struct((1 / a).alias("term"), (1 / a).alias("sum"))
    grow = lambda s, i: F.when(s["term"] < s["sum"] * CLOSE, s).otherwise(F.struct((s["term"] * x / (a + i)).alias("term"), (s["sum"] + s["term"] * x / (a + i)).alias("sum")))
    below = 1 - front * F.aggregate(_steps(a), start, grow)["sum"]

    first = 1 / _away(x + 1 - a)
    opened = F.struct(F.lit(1 / SMALL).alias("c"), first.alias("d"), first.alias("h"), F.lit(False).alias("done"))

    def deeper(s, i):
        n = i * (a - i)
        b = x + 1 - a + 2 * i
        d, c = 1 / _away(n * s["d"] + b), _away(b + n / s["c"])
        return F.when(s["done"], s).otherwise(F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"), (F.abs(c * d - 1) < CLOSE).alias("done")))

    above = front * F.aggregate(_steps(a), opened, deeper)["h"]
    return F.when(x <= 0, 1.0).when(x < a + 1, below).otherwise(above)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function; the state carries the next term, so that it is worked out once."""

    def term(m):  # of m = 2, 3, ...
        k = F.floor(m / 2)
        even = k * (b - k) / ((a + 2 * k - 1) * (a + 2 * k))
        odd = -(a + k) * (a + b + k) / ((a + 2 * k) * (a + 2 * k + 1))
        return x * F.when(m % 2 == 0, even).otherwise(odd)

    d0 = 1 / _away(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"), F.lit(0.0).alias("moved"), term(F.lit(2)).alias("term"))

    def deeper(s, i):
        d, c = 1 / _away(1 + s["term"] * s["d"]), _away(1 + s["term"] / s["c"])
        return F.when(F.abs(s["moved"] - 1) < CLOSE, s).otherwise(F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"), (c * d).alias("moved"), term(i + 2).alias("term")))

    return F.aggregate(_steps(4 * F.greatest(a, b)), start, deeper)["h"]


def beta_ratio(a: Column, b: Column, x: Column, rest: Column) -> Column:
    """I_x(a, b), the regularised incomplete beta function; rest is 1 - x, given by itself so that it keeps its digits."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(rest))
    direct = front * _beta_fraction(a, b, x) / a
    turned = 1 - front * _beta_fraction(b, a, rest) / b
    return F.when(x <= 0, 0.0).when(rest <= 0, 1.0).when(x < (a + 1) / (a + b + 2), direct).otherwise(turned)


def chi_square_p(x: Column, df: Column) -> Column:
    """The chance of a chi-square value of at least x; null for no degree of freedom."""
    return F.when(df > 0, gamma_tail(df.cast("double") / 2, x.cast("double") / 2))


def normal_p(z: Column) -> Column:
    """The chance of a standard normal value at least as far from 0 as z, on either side."""
    z = z.cast("double")
    return F.when(z.isNotNull(), gamma_tail(F.lit(0.5), z * z / 2))


def t_p(t: Column, df: Column) -> Column:
    """The chance of a value of Student's distribution at least as far from 0 as t, on either side; null for no degree of freedom."""
    t, n = t.cast("double"), df.cast("double")
    square = t * t
    return F.when((n > 0) & t.isNotNull(), F.when(F.isnan(square) | (square == float("inf")), F.when(F.isnan(t), None).otherwise(0.0)).otherwise(beta_ratio(n / 2, F.lit(0.5), n / (n + square), square / (n + square))))


def t_quantile(p: float, df: Column, rounds: int = 60) -> Column:
    """The value that Student's distribution exceeds on either side with a chance of p.

    Newton steps on the tail from the left of the root: the tail is convex there, so they rise to it and never pass it.
    """
    n = df.cast("double")
    log_scale = log_gamma((n + 1) / 2) - log_gamma(n / 2) - 0.5 * F.ln(n * 3.141592653589793)

    def step(s, _):
        t = s["t"]
        density = F.exp(log_scale - (n + 1) / 2 * F.log1p(t * t / n))
        return F.when(F.abs(t - s["before"]) <= 1e-14 * t, s).otherwise(F.struct((t + (t_p(t, n) - p) / (2 * density)).alias("t"), t.alias("before")))

    start = F.struct(F.lit(0.1).alias("t"), F.lit(0.0).alias("before"))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)["t"])
