"""Tail probabilities for t, F, chi-square and normal statistics.

Vectorised numpy (regularised incomplete beta and gamma by continued
fractions / series) inside Arrow-batched pandas UDFs. They run over result
tables (one row per test), never over raw rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LGAMMA = np.frompyfunc(math.lgamma, 1, 1)
_TINY = 1e-300
_EPS = 3e-16


def _lgamma(x):
    return _LGAMMA(np.asarray(x, dtype=float)).astype(float)


def _betacf(a, b, x, iters: int = 400):
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = np.where(np.abs(d) < _TINY, _TINY, d)
    d = 1.0 / d
    h = d.copy()
    done = np.zeros_like(x, dtype=bool)
    for m in range(1, iters + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < _TINY, _TINY, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        d = 1.0 / d
        h = np.where(done, h, h * d * c)
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < _TINY, _TINY, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        d = 1.0 / d
        delta = d * c
        h = np.where(done, h, h * delta)
        done |= np.abs(delta - 1.0) < _EPS
        if done.all():
            break
    return h


def betainc(a, b, x):
    """Regularised incomplete beta I_x(a, b), elementwise."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    out[ok & (x == 0)] = 0.0
    out[ok & (x == 1)] = 1.0
    m = ok & (x > 0) & (x < 1)
    if m.any():
        aa, bb, xx = a[m], b[m], x[m]
        lbt = _lgamma(aa + bb) - _lgamma(aa) - _lgamma(bb) + aa * np.log(xx) + bb * np.log1p(-xx)
        bt = np.exp(lbt)
        direct = xx < (aa + 1.0) / (aa + bb + 2.0)
        res = np.empty_like(xx)
        if direct.any():
            res[direct] = bt[direct] * _betacf(aa[direct], bb[direct], xx[direct]) / aa[direct]
        if (~direct).any():
            r = ~direct
            res[r] = 1.0 - bt[r] * _betacf(bb[r], aa[r], 1.0 - xx[r]) / bb[r]
        out[m] = res
    return out


def gammaincc(a, x, iters: int = 600):
    """Regularised upper incomplete gamma Q(a, x), elementwise."""
    a, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, x))
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & (x >= 0)
    out[ok & (x == 0)] = 1.0
    m = ok & (x > 0)
    if not m.any():
        return out
    aa, xx = a[m], x[m]
    gln = _lgamma(aa)
    res = np.empty_like(xx)
    ser = xx < aa + 1.0
    if ser.any():  # series for P, then Q = 1 - P
        a1, x1 = aa[ser], xx[ser]
        ap = a1.copy()
        s = 1.0 / a1
        dl = s.copy()
        for _ in range(iters):
            ap += 1.0
            dl *= x1 / ap
            s += dl
            if (np.abs(dl) < np.abs(s) * _EPS).all():
                break
        res[ser] = 1.0 - s * np.exp(-x1 + a1 * np.log(x1) - gln[ser])
    cf = ~ser
    if cf.any():  # Lentz continued fraction for Q
        a1, x1 = aa[cf], xx[cf]
        b = x1 + 1.0 - a1
        c = np.full_like(x1, 1.0 / _TINY)
        d = 1.0 / b
        h = d.copy()
        done = np.zeros_like(x1, dtype=bool)
        for i in range(1, iters + 1):
            an = -i * (i - a1)
            b = b + 2.0
            d = an * d + b
            d = np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            d = 1.0 / d
            delta = d * c
            h = np.where(done, h, h * delta)
            done |= np.abs(delta - 1.0) < _EPS
            if done.all():
                break
        res[cf] = np.exp(-x1 + a1 * np.log(x1) - gln[cf]) * h
    out[m] = res
    return out


def t_two_sided(t, df):
    t = np.asarray(t, dtype=float)
    df = np.asarray(df, dtype=float)
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def f_upper(f, d1, d2):
    f = np.asarray(f, dtype=float)
    d1 = np.asarray(d1, dtype=float)
    d2 = np.asarray(d2, dtype=float)
    out = betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))
    return np.where(f <= 0, 1.0, out)


def chi2_upper(x, k):
    return gammaincc(np.asarray(k, dtype=float) / 2.0, np.asarray(x, dtype=float) / 2.0)


def norm_two_sided(z):
    z = np.abs(np.asarray(z, dtype=float))
    return np.array([math.erfc(v / math.sqrt(2.0)) if np.isfinite(v) else np.nan for v in z])


def _clean(a):
    s = pd.Series(a, dtype="float64")
    return s.where(np.isfinite(s), None)


@F.pandas_udf(T.DoubleType())
def t_sf(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of a t statistic."""
    return _clean(t_two_sided(t.to_numpy(dtype=float, na_value=np.nan), df.to_numpy(dtype=float, na_value=np.nan)))


@F.pandas_udf(T.DoubleType())
def f_sf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper tail of an F statistic."""
    return _clean(f_upper(f.to_numpy(dtype=float, na_value=np.nan), d1.to_numpy(dtype=float, na_value=np.nan),
                          d2.to_numpy(dtype=float, na_value=np.nan)))


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, k: pd.Series) -> pd.Series:
    """Upper tail of a chi-square statistic."""
    return _clean(chi2_upper(x.to_numpy(dtype=float, na_value=np.nan), k.to_numpy(dtype=float, na_value=np.nan)))


@F.pandas_udf(T.DoubleType())
def norm_sf(z: pd.Series) -> pd.Series:
    """Two-sided normal p of a z statistic."""
    return _clean(norm_two_sided(z.to_numpy(dtype=float, na_value=np.nan)))


def pearson_p(r: Column, n: Column) -> Column:
    """p of Pearson r with n pairs (t with n - 2 df); r = +-1 gives 0."""
    df = n.cast("double") - 2
    t = r * F.sqrt(df / F.greatest(F.lit(1e-300), 1 - r * r))
    return F.when((n > 2) & r.isNotNull(), F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(t_sf(t, df)))
