"""Small statistical functions: unit-root and correlation p-values."""

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Published response-surface coefficients of the unit-root test with a constant, one series.
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
SMALL_P = (2.1659, 1.4412, 0.038269)
LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)

SERIES_TERMS, NODES = 160, 64


def unit_root_p(stat: float) -> float:
    """p-value of the Dickey-Fuller t-statistic."""
    if stat > TAU_MAX:
        return 1.0
    if stat < TAU_MIN:
        return 0.0
    coefficients = SMALL_P if stat <= TAU_STAR else LARGE_P
    z = sum(c * stat ** k for k, c in enumerate(coefficients))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def unit_root_critical(p: float) -> float:
    """The statistic whose p-value is ``p``: comparing statistics with it equals comparing p-values."""
    lo, hi = TAU_MIN, TAU_STAR if p <= unit_root_p(TAU_STAR) else TAU_MAX
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if unit_root_p(mid) < p else (lo, mid)
    return hi


def normal_cdf(z) -> Column:
    """The normal distribution function by its series of odd factorials; beyond 8.5 it is 0 or 1 to rounding."""
    near = F.greatest(F.least(z, F.lit(8.5)), F.lit(-8.5))
    square = near * near
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(s, k):
        term = s["term"] * square / (2 * k + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(SERIES_TERMS)), zero, add, lambda s: s["sum"])
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) + near * series * F.exp(-square / 2) / math.sqrt(2 * math.pi)))


def unit_root_p_column(stat) -> Column:
    """``unit_root_p`` of a column; null stays null."""
    x = F.col(stat) if isinstance(stat, str) else stat
    poly = lambda cs: sum((F.lit(c) * F.pow(x, F.lit(k)) for k, c in enumerate(cs)), F.lit(0.0))
    z = F.when(x <= TAU_STAR, poly(SMALL_P)).otherwise(poly(LARGE_P))
    return F.when(x > TAU_MAX, 1.0).when(x < TAU_MIN, 0.0).when(x.isNotNull(), normal_cdf(z))


def _gamma_ratio(x) -> Column:
    """gamma(x + 1/2) / gamma(x) for x >= 1/2: the asymptotic series at x + 20, taken back by the recursion."""
    y = x + 20
    out = F.sqrt(y) * (1 - 1 / (8 * y) + 1 / (128 * y * y) + 5 / (1024 * F.pow(y, F.lit(3))) - 21 / (32768 * F.pow(y, F.lit(4)))
                       - 399 / (262144 * F.pow(y, F.lit(5))))
    for i in range(20):
        out = out * (x + i) / (x + i + 0.5)
    return out


def correlation_p_column(r, n) -> Column:
    """Two-sided p-value of a correlation over ``n`` pairs (Student t, n - 2 degrees of freedom); null below three pairs.

    With sin(u) = r the probability of a smaller |t| is an integral of cos(u) ** (n - 3), taken at a fixed number of
    Gauss-Legendre nodes over the part that matters, so it costs the same for any ``n``.
    """
    r, df = F.abs(F.col(r)), F.col(n).cast("double") - 2
    end = F.asin(F.least(r, F.lit(1.0), 9 / F.sqrt(F.when(df > 0, df))))
    nodes = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(w)).alias("w")) for x, w in zip(*np.polynomial.legendre.leggauss(NODES))])
    inside = F.aggregate(nodes, F.lit(0.0), lambda s, q: s + q["w"] * F.pow(F.cos(end * (q["x"] + 1) / 2), df - 1)) * end / 2
    p = 1 - 2 / math.sqrt(math.pi) * _gamma_ratio(df / 2) * inside
    return F.when((df > 0) & (r >= 1), 0.0).when((df > 0) & r.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))
