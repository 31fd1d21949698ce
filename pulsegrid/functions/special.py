"""Tail probabilities of test statistics.

Used on aggregated rows only (one per test), as Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def _betacf(a, b, x):
    """Continued fraction of the incomplete beta function, elementwise."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    return h


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def beta_inc(a, b, x):
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    out = np.full(a.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(b) & np.isfinite(x) & (a > 0) & (b > 0)
    out[ok & (x <= 0)] = 0.0
    out[ok & (x >= 1)] = 1.0
    mid = ok & (x > 0) & (x < 1)
    if mid.any():
        a_, b_, x_ = a[mid], b[mid], x[mid]
        front = np.exp(_lgamma(a_ + b_) - _lgamma(a_) - _lgamma(b_) + a_ * np.log(x_) + b_ * np.log1p(-x_))
        low = x_ < (a_ + 1) / (a_ + b_ + 2)
        res = np.where(
            low,
            front * _betacf(a_, b_, np.where(low, x_, 0.5)) / a_,
            1.0 - front * _betacf(b_, a_, np.where(low, 0.5, 1 - x_)) / b_,
        )
        out[mid] = res
    return out


def t_two_sided(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_upper(f, d1, d2):
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def gamma_tails(a, z):
    """Lower and upper regularised incomplete gamma functions, by series below and continued fraction above the mean.

    Each tail is right to its own last digits, however small.
    """
    a, z = np.broadcast_arrays(np.asarray(a, float), np.asarray(z, float))
    low, out = np.full(a.shape, np.nan), np.full(a.shape, np.nan)
    for i in np.ndindex(a.shape):
        if not (np.isfinite(a[i]) and np.isfinite(z[i])) or a[i] <= 0:
            continue
        if z[i] <= 0:
            low[i], out[i] = 0.0, 1.0
            continue
        lead = math.exp(-z[i] + a[i] * math.log(z[i]) - math.lgamma(a[i]))
        if z[i] < a[i] + 1:
            term = total = 1.0 / a[i]
            n = a[i]
            while abs(term) > 1e-16 * abs(total):
                n += 1
                term *= z[i] / n
                total += term
            low[i], out[i] = total * lead, 1.0 - total * lead
        else:
            b, c = z[i] + 1 - a[i], 1e300
            d = 1 / b
            h = d
            for m in range(1, 1000):
                an = -m * (m - a[i])
                b += 2
                d = 1 / (an * d + b if abs(an * d + b) > 1e-300 else 1e-300)
                c = b + an / c if abs(b + an / c) > 1e-300 else 1e-300
                h *= d * c
                if abs(d * c - 1) < 1e-15:
                    break
            low[i], out[i] = 1.0 - h * lead, h * lead
    return low, out


def chi2_upper(x, k):
    """Upper tail of chi-square."""
    return gamma_tails(np.asarray(k, float) / 2, np.asarray(x, float) / 2)[1]


def poisson_upper(n, lam):
    """Probability of ``n`` or more events at mean ``lam``."""
    n = np.asarray(n, float)
    return np.where(n <= 0, 1.0, gamma_tails(np.maximum(n, 1e-300), lam)[0])


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of a t statistic."""
    return pd.Series(t_two_sided(t, df))


@F.pandas_udf(T.DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper-tail p of an F statistic."""
    return pd.Series(f_upper(f, d1, d2))


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series(chi2_upper(x, k))


@F.pandas_udf(T.DoubleType())
def poisson_p(n: pd.Series, lam: pd.Series) -> pd.Series:
    """Probability of ``n`` or more events at mean ``lam``."""
    return pd.Series(poisson_upper(n, lam))


def digamma_of(v: np.ndarray) -> np.ndarray:
    """Derivative of log gamma for positive arguments."""
    shift = np.zeros_like(v)
    big = v.copy()
    for _ in range(6):
        small = big < 6
        shift = shift - np.where(small, 1.0 / np.where(small, big, 1.0), 0.0)
        big = np.where(small, big + 1, big)
    inv = 1.0 / (big * big)
    series = np.log(big) - 0.5 / big - inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252 - inv * (1 / 240 - inv / 132))))
    return series + shift


def trigamma_of(v: np.ndarray) -> np.ndarray:
    """Derivative of digamma for positive arguments."""
    big = np.asarray(v, float) + 6
    inv = 1.0 / (big * big)
    series = 1 / big + inv / 2 + inv / big * (1 / 6 - inv * (1 / 30 - inv * (1 / 42 - inv / 30)))
    return series + sum(1.0 / (big - i) ** 2 for i in range(1, 7))


@F.pandas_udf(T.DoubleType())
def digamma(x: pd.Series) -> pd.Series:
    """Derivative of log gamma for positive arguments."""
    return pd.Series(digamma_of(x.to_numpy(float)))


def kolmogorov_p(lam: Column) -> Column:
    """Upper tail of the Kolmogorov distribution, as a JVM expression."""
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(100)),
        lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))
