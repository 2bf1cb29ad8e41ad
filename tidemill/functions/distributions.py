"""Tail probabilities for aggregated statistics, as pandas UDFs over incomplete beta and gamma functions.

They run on rows of aggregates (one for a model or an instrument), never on observations.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:  # series of the lower part
        term = total = 1 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    tiny = 1e-300  # continued fraction
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 1000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi2_tail(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def t_two_sided(t: float, df: float) -> float:
    return beta_i(df / 2, 0.5, df / (df + t * t))


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided probability at one half: of all counts as unlikely as k or more."""
    if n <= 0:
        return 1.0
    low = min(k, n - k)
    if 2 * low == n:
        return 1.0
    return min(1.0, 2 * beta_i(n - low, low + 1, 0.5))


def binomial_at_least(k: int, n: int) -> float:
    """P(X >= k) of n fair draws."""
    return beta_i(k, n - k + 1, 0.5) if k > 0 else 1.0


def t_quantile(p: float, df: float) -> float:
    """Student's t at probability p, by bisection of the tail to the last bits."""
    if p == 0.5:
        return 0.0
    tail, lo, hi = 2 * min(p, 1 - p), 0.0, 1.0
    while t_two_sided(hi, df) > tail:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if t_two_sided(mid, df) > tail else (lo, mid)
    return lo if p > 0.5 else -lo


def _udf(f):
    """A pandas UDF of a scalar function; null in, null out."""

    def make(*columns: Column) -> Column:
        @F.pandas_udf("double")
        def run(*parts: pd.Series) -> pd.Series:
            return pd.Series([None if any(pd.isna(v) for v in row) else f(*row) for row in zip(*parts)], dtype="float64")

        return run(*columns)

    return make


chi2_sf, t_p_value, binomial_p = _udf(chi2_tail), _udf(t_two_sided), _udf(binomial_two_sided)
binomial_upper = _udf(binomial_at_least)
normal_cdf = _udf(NormalDist().cdf)
