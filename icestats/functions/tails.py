"""Tail probabilities for test statistics (small per-row helpers)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def normal_tail(z: float) -> float:
    """Two-sided p-value of a normal statistic."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of chi-square for a whole number of degrees of freedom."""
    if x <= 0:
        return 1.0
    half = x / 2.0
    if df % 2:
        q, k, term = math.erfc(math.sqrt(half)), 1, math.sqrt(half) * math.exp(-half) / math.gamma(1.5)
        while k < df:
            q, k, term = q + term, k + 2, term * half / (k / 2.0 + 1.0)
    else:
        q, k, term = math.exp(-half), 2, half * math.exp(-half)
        while k < df:
            q, k, term = q + term, k + 2, term * half / (k / 2.0 + 1.0)
    return min(q, 1.0)


#: Degrees of freedom above which the normal tail with its first correction is exact to 1e-12.
LARGE_DF = 1e6


def t_tail(t: float, df: float) -> float:
    """Two-sided p-value of Student's t.

    The incomplete beta integral I(df / (df + t^2); df / 2, 1 / 2) as a continued fraction,
    beyond LARGE_DF the normal tail plus its term in 1 / df.
    """
    t = abs(t)
    if math.isinf(t):
        return 0.0
    if df > LARGE_DF:
        density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
        return min(1.0, normal_tail(t) + 2 * density * (t**3 + t) / (4 * df))
    x, y = df / (df + t * t), t * t / (df + t * t)
    if t == 0:
        return 1.0
    if x < (df / 2 + 1) / (df / 2 + 2.5):
        return _beta_part(x, y, df / 2, 0.5)
    return 1.0 - _beta_part(y, x, 0.5, df / 2)


def _beta_part(x: float, y: float, a: float, b: float) -> float:
    """Regularised incomplete beta for x left of the bulk, y = 1 - x."""
    front = math.exp(a * math.log(x) + b * math.log(y) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    # convergents p/q of 1 / (1 + d1 / (1 + d2 / ...)), rescaled as they grow
    p0, q0, p1, q1, value, m = 1.0, 0.0, 1.0, 1.0, 1.0, 0
    while True:
        m += 1
        k = m // 2
        d = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)) if m % 2 == 0 else -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        p0, p1, q0, q1 = p1, p1 + d * p0, q1, q1 + d * q0
        scale = 1.0 / q1
        p0, p1, q0, q1 = p0 * scale, p1 * scale, q0 * scale, 1.0
        if abs(p1 - value) <= 1e-15 * abs(p1) or m > 100_000:
            return front / p1
        value = p1


def normal_tail_column(z: Column) -> Column:
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: math.erfc(abs(x) / math.sqrt(2.0)))

    return pandas_udf(run, "double")(z)


def t_tail_column(t: Column, df: Column) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x != x or y != y else t_tail(x, y) for x, y in zip(a, b)], dtype=float)

    return pandas_udf(run, "double")(t, df)


def kolmogorov_tail(lam: Column, terms: int = 100) -> Column:
    """Asymptotic p-value of the Kolmogorov statistic as a fixed-length series."""
    s = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda a, k: a + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    return F.when(lam < 0.04, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s * 2)))
