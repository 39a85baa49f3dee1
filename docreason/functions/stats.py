"""Distribution tails for the few rows of a test table.

Tests aggregate to one row per comparison; the p values are then computed by
a vectorised pandas function over those rows. Neither Spark nor the image
ships a Student-t distribution, so the tail uses the regularised incomplete
beta function by its continued fraction.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction 1 / (1 + t1 / (1 + t2 / (1 + ...))) of the
    incomplete beta function (DLMF 8.17.22), evaluated from its far end; it
    converges in a number of terms of the order of sqrt(max(a, b))."""
    terms = 60 + 6 * math.ceil(math.sqrt(max(a, b)))
    value = 1.0
    for k in range(terms, 0, -1):
        m = k // 2
        if k % 2:
            t = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            t = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        value = 1.0 + t / value
    return 1.0 / value


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b); beyond the mean by symmetry,
    where the fraction converges fast."""
    if not 0.0 < x < 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - betainc(b, a, 1.0 - x)
    log_front = a * math.log(x) + b * math.log1p(-x) - math.log(a) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return math.exp(log_front) * _beta_fraction(a, b, x)


def t_sf(t: float, df: float) -> float:
    """P(T > t) for Student's t with ``df`` degrees of freedom."""
    if t is None or df is None or math.isnan(t) or df <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0 if t > 0 else 1.0
    tail = 0.5 * betainc(df / 2.0, 0.5, df / (df + t * t))
    return tail if t > 0 else 1.0 - tail


def norm_sf(z: float) -> float:
    """P(Z > z) for the standard normal."""
    if z is None or math.isnan(z):
        return float("nan")
    return 0.5 * math.erfc(z / math.sqrt(2.0))


#: Largest sample whose signed-rank tail is taken from the exact distribution;
#: the counts of its subsets (at most 2**50) are exact in DOUBLE.
EXACT_RANKS = 50


@lru_cache(maxsize=EXACT_RANKS)
def _rank_sums(n: int) -> np.ndarray:
    """How many subsets of the ranks 1..n have each sum 0..n(n+1)/2."""
    counts = np.ones(1)
    for rank in range(1, n + 1):
        with_rank = np.concatenate([np.zeros(rank), counts])
        counts = with_rank + np.concatenate([counts, np.zeros(rank)])
    return counts


def signed_rank_sf(w: float, n: int) -> float:
    """P(W >= w) of the signed-rank statistic of n untied non-zero differences
    under the null hypothesis (each rank is positive with probability 1/2);
    NaN for no difference or more than ``EXACT_RANKS``."""
    if not 0 < n <= EXACT_RANKS:
        return float("nan")
    return float(_rank_sums(n)[max(math.ceil(w), 0):].sum() / 2.0 ** n)


@F.pandas_udf(DoubleType())
def signed_rank_sf_udf(w: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_sf(a, int(b)) if pd.notna(a) and pd.notna(b) else np.nan for a, b in zip(w, n)])


@F.pandas_udf(DoubleType())
def t_sf_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_sf(a, b) if pd.notna(a) and pd.notna(b) else np.nan for a, b in zip(t, df)])


@F.pandas_udf(DoubleType())
def norm_sf_udf(z: pd.Series) -> pd.Series:
    return pd.Series([norm_sf(a) if pd.notna(a) else np.nan for a in z])
