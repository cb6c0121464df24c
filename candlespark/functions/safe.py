"""Null-safe arithmetic: every undefined result is NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def div(a, b) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def ieee_div(a, b) -> Column:
    """a / b as floating point has it: infinite where b is 0, NaN for 0 / 0.  A zero ``b`` counts as +0."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(a / b)


def ln(x) -> Column:
    """Natural logarithm, NULL for x <= 0."""
    x = _c(x)
    return F.when(x > 0, F.ln(x))


def finite(x) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    x = _c(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def no_nan(x) -> Column:
    x = _c(x)
    return F.when(~F.isnan(x), x)


def root(x) -> Column:
    """Square root of x, with rounding noise below 0 read as 0."""
    return F.sqrt(F.greatest(_c(x), F.lit(0.0)))


def normal_cdf(z) -> Column:
    """Standard normal distribution from the rational approximation 7.1.26 of
    Abramowitz and Stegun (error below 1e-7)."""
    # Published coefficients.
    p, coef = 0.3275911, [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
    z = _c(z)
    x = F.abs(z) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(p) * x)
    poly = F.lit(0.0)
    for c in reversed(coef):
        poly = (poly + F.lit(c)) * t
    half = F.lit(0.5) * poly * F.exp(-x * x)
    return F.when(z >= 0, F.lit(1.0) - half).otherwise(half)
