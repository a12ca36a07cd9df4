"""Student t tail probabilities and quantiles of single numbers.

The survival function uses the regularized incomplete beta function, evaluated by its continued fraction
(modified Lentz iteration); the quantile inverts it by bisection. Columns use ``functions/dist.py``.
"""

from __future__ import annotations

import math
from functools import lru_cache

_TINY = 1e-300


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 400):
        m2 = 2 * m
        for num in (m * (b - m) * x / ((qam + m2) * (a + m2)),
                    -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + num / c
            c = c if abs(c) > _TINY else _TINY
            step = d * c
            h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(log_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_cf(a, b, x) / a
    return 1.0 - front * _beta_cf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, dof: float) -> float:
    """P(|T| > |t|) for T ~ t(dof): ``summary(lm)``'s Pr(>|t|)."""
    return betainc(dof / 2.0, 0.5, dof / (dof + t * t))


@lru_cache(maxsize=4096)
def t_quantile(p: float, dof: float) -> float:
    """The p-quantile of t(dof), p in (0, 1)."""
    if p == 0.5:
        return 0.0
    upper = p > 0.5
    tail = 1.0 - p if upper else p          # one-sided tail probability
    lo, hi = 0.0, 1.0
    while t_two_sided_p(hi, dof) / 2.0 > tail:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if t_two_sided_p(mid, dof) / 2.0 > tail:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-13 * max(1.0, hi):
            break
    q = (lo + hi) / 2.0
    return q if upper else -q
