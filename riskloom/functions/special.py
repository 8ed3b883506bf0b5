"""Distribution functions that neither Spark nor the installed libraries provide."""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Standard normal quantiles at 5 % and 1 %.
Z_05 = -1.6448536269514727
Z_01 = -2.3263478740408408


def chi_square_tail(x: float, df: int) -> float:
    """P(X > x) for one or two degrees of freedom."""
    if df == 1:
        return math.erfc(math.sqrt(x / 2))
    if df == 2:
        return math.exp(-x / 2)
    raise ValueError("df must be 1 or 2")


@F.pandas_udf(T.DoubleType())
def chi_square_1(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or v != v else chi_square_tail(v, 1))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return out


def beta_ratio(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return min(1.0, max(0.0, x))
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_cdf(x: float, df: float) -> float:
    tail = beta_ratio(df / 2, 0.5, df / (df + x * x)) / 2
    return tail if x < 0 else 1 - tail


@lru_cache(maxsize=4096)
def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t by bisection; p below one half gives a negative value."""
    if p == 0.5:
        return 0.0
    if p > 0.5:
        return -t_quantile(1 - p, df)
    low, high = -2.0, 0.0
    while t_cdf(low, df) > p:
        low *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def standardised_quantiles(df: float | None) -> tuple[float, float]:
    """5 % and 1 % quantiles with unit variance: normal without df, else Student's t."""
    if df is None:
        return Z_05, Z_01
    shrink = math.sqrt((df - 2) / df)
    return t_quantile(0.05, df) * shrink, t_quantile(0.01, df) * shrink


@F.pandas_udf(T.StructType([T.StructField("q05", T.DoubleType()), T.StructField("q01", T.DoubleType())]))
def student_t_quantiles(df: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([standardised_quantiles(float(v)) for v in df], columns=["q05", "q01"])
