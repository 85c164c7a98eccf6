"""Special functions and distributions in numpy, and as Arrow-batched Columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _erfc(x):
    x = np.asarray(x, float)
    return np.fromiter(map(math.erfc, x.ravel().tolist()), float, x.size).reshape(x.shape)


def _lgamma(x):
    x = np.asarray(x, float)
    return np.fromiter(map(math.lgamma, x.ravel().tolist()), float, x.size).reshape(x.shape)


def normal_sf(z):
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2))


def normal_cdf(z):
    return normal_sf(-np.asarray(z, float))


def _bisect(f, target, lo, hi, rounds=200):
    """x in [lo, hi] with f(x) = target for an increasing f, elementwise."""
    target = np.asarray(target, float)
    lo, hi = np.broadcast_to(np.asarray(lo, float), target.shape).copy(), np.broadcast_to(np.asarray(hi, float), target.shape).copy()
    for _ in range(rounds):
        mid = (lo + hi) / 2
        low = f(mid) < target
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


def normal_ppf(p):
    return _bisect(normal_cdf, p, -40.0, 40.0)


def gammainc(a, x):
    """Regularised lower incomplete gamma: a series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.zeros(a.shape)
    front = np.exp(np.where(x > 0, a * np.log(np.where(x > 0, x, 1)) - x - _lgamma(a), -np.inf))
    small = (x < a + 1) & (x > 0)
    if small.any():
        term = 1 / a[small]
        total = term.copy()
        for n in range(1, 2000):
            term = term * x[small] / (a[small] + n)
            total += term
            if (np.abs(term) < 1e-16 * np.abs(total)).all():
                break
        out[small] = total * front[small]
    big = ~small & (x > 0)
    if big.any():
        A, X = a[big], x[big]
        b = X + 1 - A
        c, d = np.full(A.shape, 1e300), 1 / b
        h = d.copy()
        for n in range(1, 2000):
            an = -n * (n - A)
            b = b + 2
            d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
            c = np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
            step = d * c
            h *= step
            if (np.abs(step - 1) < 1e-16).all():
                break
        out[big] = 1 - front[big] * h
    return out


def betainc(a, b, x):
    """Regularised incomplete beta by its continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    x = np.clip(x, 0, 1)
    flip = x > (a + 1) / (a + b + 2)
    A, B, X = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(A + B) - _lgamma(A) - _lgamma(B) + A * np.log(X) + B * np.log1p(-X))
    front = np.where((X <= 0) | (X >= 1), 0.0, front)
    tiny = 1e-300
    c = np.ones(A.shape)
    d = 1 - (A + B) * X / (A + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 500):
        for num in (m * (B - m) * X / ((A + 2 * m - 1) * (A + 2 * m)), -(A + m) * (A + B + m) * X / ((A + 2 * m) * (A + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    value = np.where(X >= 1, 1.0, front * h / A)
    return np.where(flip, 1 - value, value)


def chi2_cdf(x, df):
    return gammainc(np.asarray(df, float) / 2, np.maximum(np.asarray(x, float), 0) / 2)


def chi2_sf(x, df):
    return 1 - chi2_cdf(x, df)


def chi2_ppf(p, df):
    df = np.asarray(df, float)
    return _bisect(lambda x: chi2_cdf(x, df), p, 0.0, np.max(df) * 10 + 200)


def gamma_ppf(p, shape, rate=1.0):
    return chi2_ppf(p, 2 * np.asarray(shape, float)) / (2 * np.asarray(rate, float))


def t_two_sided(t, df):
    t = np.asarray(t, float)
    return betainc(np.asarray(df, float) / 2, 0.5, df / (df + t * t))


def f_sf(x, d1, d2):
    x = np.asarray(x, float)
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def poisson_sf(k, mean):
    """P(X > k)."""
    return gammainc(np.maximum(np.floor(np.asarray(k, float)) + 1, 1e-300), mean)


def poisson_cdf(k, mean):
    return 1 - poisson_sf(k, mean)


def poisson_ppf(p, mean):
    """Least k with P(X <= k) >= p."""
    p, mean = np.broadcast_arrays(np.asarray(p, float), np.asarray(mean, float))
    lo, hi = np.full(p.shape, -1.0), np.ceil(mean + 40 * np.sqrt(mean + 1) + 40)
    while (hi - lo > 1).any():
        mid = np.floor((lo + hi) / 2)
        enough = poisson_cdf(mid, mean) >= p
        hi, lo = np.where(enough & (hi - lo > 1), mid, hi), np.where(~enough & (hi - lo > 1), mid, lo)
    return hi


def garwood(observed, expected, alpha: float = 0.05):
    """Exact limits of a standardised ratio."""
    observed, expected = np.asarray(observed, float), np.asarray(expected, float)
    lower = np.where(observed > 0, chi2_ppf(alpha / 2, 2 * np.maximum(observed, 1e-9)) / 2, 0.0)
    upper = chi2_ppf(1 - alpha / 2, 2 * (observed + 1)) / 2
    return lower / expected, upper / expected


def as_column(function, *columns: Column) -> Column:
    """``function`` of arrays as an Arrow-batched Column of doubles; null where an argument is."""

    @F.pandas_udf("double")
    def call(*series: pd.Series) -> pd.Series:
        values = [s.to_numpy(dtype=float, na_value=np.nan) for s in series]
        good = np.all([np.isfinite(v) for v in values], axis=0)
        out = np.full(len(good), np.nan)
        if good.any():
            out[good] = function(*(v[good] for v in values))
        return pd.Series(out).where(good)

    return call(*columns)
