"""Per-row training losses as column expressions.

The zero-agnostic return loss is defined by its slope along the prediction.
With outcome size a = |z_true| and u = sign(z_true) * z_pred it falls from the
far wrong side to u = a, where it is 0, and rises beyond:

* wrong side, u < 0: slope -(1 - rise * u);
* short of the outcome, 0 < u < a: slope -w(u), w(x) = k / (1 + (x + shift)^2);
* beyond it, u > a: slope w(a) + min(|w'(a)|, rise) * (u - a);

``shift`` = alpha / sqrt(3), k = 1 + shift^2 (so w(0) = 1), rise = |w'(0)|.
The loss is the area below the slope between u and a.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from candlespark.functions.safe import _c


class Weight:
    """The slope weight w for one ``alpha``: its values, steepness and area, for columns and for constants."""

    def __init__(self, alpha: float):
        if not 0 <= alpha <= 1:
            raise ValueError(f"alpha must lie in [0, 1], got {alpha}")
        self.shift = alpha / math.sqrt(3.0)
        self.k = 1.0 + self.shift**2
        self.rise = 2.0 * self.shift / self.k

    def at(self, x: Column) -> Column:
        return self.k / (1.0 + (x + self.shift) * (x + self.shift))

    def steepness(self, x: Column) -> Column:
        """|w'(x)| for x >= 0, no more than at 0."""
        return F.least(2.0 * (x + self.shift) * self.at(x) * self.at(x) / self.k, F.lit(self.rise))

    def area(self, x: Column) -> Column:
        """The area below w from 0 to ``x``."""
        return self.k * (F.atan(x + self.shift) - math.atan(self.shift))

    def area_to(self, x: float) -> float:
        return self.k * (math.atan(x + self.shift) - math.atan(self.shift))


def _scaled(y, p, std, mean) -> tuple[Column, Column, Column, Column]:
    """z_true, its direction, its size a, and the prediction u in that direction."""
    z = (_c(y) - _c(mean)) / _c(std)
    side = F.when(z < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return z, side, F.abs(z), side * (_c(p) - _c(mean)) / _c(std)


def softening(size: Column, alpha: float, epsilon: float, tau: float) -> Column:
    """Extra loss near a zero outcome, so that small outcomes do not matter.

    It starts at the area E of the weight up to ``epsilon`` and follows what is
    left of E after the outcome's own area: a ramp that reaches 0 at
    ``epsilon``, with its corner rounded by ``tau`` relative to the ramp's limit
    for large outcomes.
    """
    w = Weight(alpha)
    full = w.area_to(epsilon)
    left = F.lit(1.0) - w.area(size) / full
    if tau <= 0:
        return full * F.greatest(left, F.lit(0.0))
    corner = abs(tau) * abs(1.0 - w.area_to(math.inf) / full)
    rounded = F.greatest(left, F.lit(0.0)) + corner * F.log1p(F.exp(-F.abs(left) / corner))
    return rounded * (full / (1.0 + corner * math.log1p(math.exp(-1.0 / corner))))


def czar_loss(y, p, std, mean=0.0, alpha: float = 1.0, epsilon: float = 1.0, tau: float = 0.05) -> Column:
    """Zero-agnostic return loss: areas on the wrong side, short of the outcome and beyond it."""
    w = Weight(alpha)
    _, _, a, u = _scaled(y, p, std, mean)
    nothing = F.lit(0.0)
    behind, past = F.greatest(-u, nothing), F.greatest(u - a, nothing)
    reached = F.least(F.greatest(u, nothing), a)
    loss = behind * (1.0 + 0.5 * w.rise * behind) + w.area(a) - w.area(reached) + past * (w.at(a) + 0.5 * w.steepness(a) * past)
    return loss + softening(a, alpha, epsilon, tau) if epsilon > 0 else loss


def czar_gradient(y, p, std, mean=0.0, alpha: float = 1.0) -> Column:
    """The slope used for training: past the outcome it starts from 0, and a zero outcome has no direction."""
    w = Weight(alpha)
    z, side, a, u = _scaled(y, p, std, mean)
    slope = F.when(u <= 0, w.rise * u - F.abs(F.signum(z))).when(u <= a, -w.at(u)).otherwise(w.steepness(a) * (u - a))
    return side * slope / _c(std)


def czar_hessian(y, p, std, mean=0.0, alpha: float = 1.0) -> Column:
    """The curvature used for training, in terms of 2 x / (1 + x^2), which stays positive."""
    w = Weight(alpha)
    _, _, a, u = _scaled(y, p, std, mean)

    def pull(x: Column) -> Column:
        return 2.0 * (x + w.shift) * w.at(x) / w.k

    curve = F.when(u <= 0, F.lit(w.rise)).when(u <= a, pull(u)).otherwise(F.least(F.lit(w.rise), pull(a)))
    return curve / (_c(std) * _c(std))


def directional_loss(base, y, p, alpha: float = 1.0) -> Column:
    """Base loss, raised by ``alpha`` when the direction is wrong."""
    wrong = F.signum(_c(y)) * F.signum(_c(p)) < 0
    return _c(base) * F.when(wrong, F.lit(1.0 + alpha)).otherwise(F.lit(1.0))


def smooth_directional_loss(base, y, p, scale, alpha: float = 1.0) -> Column:
    """The same with a tanh step of width ``scale``."""
    agree = F.tanh(_c(y) * _c(p) / (_c(scale) * _c(scale)))
    return _c(base) * (1.0 + alpha * 0.5 * (1.0 - agree))


def vol_normalised_error(y, p, local_vol, floor: float = 1e-8) -> Column:
    return (_c(p) - _c(y)) / F.greatest(_c(local_vol), F.lit(floor))


def near_zero_weight(y, noise) -> Column:
    """Weight that falls continuously to 0 as |y| sinks below the noise scale."""
    y2, n2 = _c(y) * _c(y), _c(noise) * _c(noise)
    return y2 / (y2 + n2)


def under_penalty(y, p, penalty: float = 2.0) -> Column:
    """Squared error, scaled when the prediction is below the outcome."""
    err = _c(p) - _c(y)
    return err * err * F.when(err < 0, F.lit(penalty)).otherwise(F.lit(1.0))


def transition_weight(y, previous, weight: float = 3.0) -> Column:
    """Weight of rows whose outcome changes sign against the previous one."""
    return F.when(F.signum(_c(y)) * F.signum(_c(previous)) < 0, F.lit(weight)).otherwise(F.lit(1.0))


def huber(y, p, delta: float) -> Column:
    err = F.abs(_c(y) - _c(p))
    return F.when(err <= delta, 0.5 * err * err).otherwise(delta * (err - 0.5 * delta))


def quantile_loss(y, p, q: float) -> Column:
    err = _c(y) - _c(p)
    return F.greatest(q * err, (q - 1.0) * err)


def absolute(y, p) -> Column:
    return F.abs(_c(y) - _c(p))


def squared(y, p) -> Column:
    return (_c(y) - _c(p)) * (_c(y) - _c(p))
