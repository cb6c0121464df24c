"""Indicators over a window array (oldest first) of fixed length ``n``.

Every average used here (simple, exponential, MACD line and signal) is a
linear function of the window's values.  Its weights depend on ``n`` and the
periods only, so they are worked out once and applied as a dot product.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fast, slow and signal periods.
MACD_PERIODS = (12, 26, 9)

Vector = list[float]


def _ema_series(series: list[Vector], period: int) -> list[Vector]:
    """Weights of the EMA after each element; it starts from the mean of the first ``period``."""
    alpha = 2.0 / (period + 1)
    head = series[: min(period, len(series))]
    out = [[sum(col) / len(head) for col in zip(*head)]]
    for row in series[1:]:
        out.append([alpha * x + (1 - alpha) * e for x, e in zip(row, out[-1])])
    return out


def _unit(n: int) -> list[Vector]:
    return [[1.0 if i == j else 0.0 for j in range(n)] for i in range(n)]


def ema_weights(n: int, period: int) -> Vector:
    return _ema_series(_unit(n), period)[-1]


def macd_weights(n: int) -> tuple[Vector, Vector]:
    """Weights of the MACD line and of its signal for windows of ``n`` values.

    Shorter windows fall back: below the slow period the line is the fast EMA
    minus the first value and the signal 0, below the fast period both are 0.
    """
    fast, slow, signal = MACD_PERIODS
    if n < fast:
        return [0.0] * n, [0.0] * n
    quick = _ema_series(_unit(n), fast)
    if n < slow:
        line = quick[-1][:]
        line[0] -= 1.0
        return line, [0.0] * n
    lazy = _ema_series(_unit(n), slow)
    lines = [[a - b for a, b in zip(q, s)] for q, s in zip(quick, lazy)]
    return lines[-1], _ema_series(lines, signal)[-1]


def dot(values: Column, weights: Vector) -> Column:
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(values, w, lambda v, k: v * k), F.lit(0.0), lambda a, x: a + x)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def tail_mean(values: Column, n: int, k: int) -> Column:
    """Mean of the last ``k`` values; the last value when the window is shorter."""
    if n < k:
        return F.element_at(values, -1)
    return total(F.slice(values, -k, k)) / F.lit(float(k))


def ema(values: Column, n: int, period: int) -> Column:
    return dot(values, ema_weights(n, period))


def macd(values: Column, n: int) -> tuple[Column, Column]:
    line, signal = macd_weights(n)
    return dot(values, line), dot(values, signal)


def back(values: Column, k: int) -> Column:
    """The k-th value from the end (1 = newest)."""
    return F.element_at(values, -k)


def diff_std(values: Column, n: int, k: int = 6) -> Column:
    """Population standard deviation of the steps between the last ``k`` values."""
    if n < k:
        return F.lit(0.0)
    steps = [back(values, i) - back(values, i + 1) for i in range(k - 1, 0, -1)]
    mean = sum(steps[1:], steps[0]) / F.lit(float(k - 1))
    parts = [(s - mean) * (s - mean) for s in steps]
    return F.sqrt(sum(parts[1:], parts[0]) / F.lit(float(k - 1)))
