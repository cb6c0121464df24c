"""Tail probabilities that SQL lacks, evaluated on one row per group.

These run after the distributed aggregation, on report rows only.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Ship these helpers with the query: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _lgamma(x: np.ndarray) -> np.ndarray:
    """A plain function: a vectorised ufunc kept in the module could not be pickled after its first use."""
    return np.fromiter(map(math.lgamma, x.ravel()), float, x.size).reshape(x.shape)


def _fraction(a, b, x, steps: int = 400):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, steps + 1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            out = out * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return out


def betainc(a, b, x):
    """Regularised incomplete beta function I_x(a, b), element by element."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    inside = (x > 0) & (x < 1)
    y = np.where(inside, x, 0.5)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(y) + b * np.log1p(-y))
    low = y < (a + 1.0) / (a + b + 2.0)
    direct = front * _fraction(a, b, np.where(low, y, 0.5)) / a
    mirror = 1.0 - front * _fraction(b, a, np.where(low, 0.5, 1.0 - y)) / b
    return np.where(inside, np.where(low, direct, mirror), np.where(x <= 0, 0.0, 1.0))


@F.pandas_udf(DoubleType())
def corr_pvalue(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation over ``n`` pairs; 1 when it is undefined."""
    rr, df = r.to_numpy(float), n.to_numpy(float) - 2.0
    usable = (df > 0) & ~np.isnan(rr)
    safe = np.where(usable, df, 1.0)
    p = betainc(safe / 2.0, np.full_like(safe, 0.5), np.clip(1.0 - rr * rr, 0.0, 1.0))
    return pd.Series(np.where(usable, p, 1.0))


@F.pandas_udf(DoubleType())
def binomial_tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(X >= k) for X ~ Binomial(n, p)."""
    kk, nn, pp = (s.to_numpy(float) for s in (k, n, p))
    some = kk > 0
    out = betainc(np.where(some, kk, 1.0), np.where(some, nn - kk + 1.0, 1.0), pp)
    return pd.Series(np.where(some, out, 1.0))
