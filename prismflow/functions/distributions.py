"""Upper quantiles of the F, chi-square and normal distributions, accurate for tiny tail areas."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist


def _log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def _log_beta_tail(x: float, a: float, b: float) -> float:
    """log of the regularised incomplete beta I_x(a, b), by Lentz's continued fraction."""
    if x <= 0:
        return -math.inf
    if x >= 1:
        return 0.0
    if x > (a + 1) / (a + b + 2):
        other = math.exp(_log_beta_tail(1 - x, b, a))
        return math.log1p(-other) if other < 1 else -math.inf
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + up * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + up / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return a * math.log(x) + b * math.log1p(-x) - _log_beta(a, b) - math.log(a) + math.log(h)


def _bisect(rising: Callable[[float], float], target: float, low: float, high: float) -> float:
    for _ in range(400):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if rising(mid) < target else (low, mid)
    return (low + high) / 2


def f_upper(alpha: float, d1: float, d2: float) -> float:
    """The value that an F(d1, d2) variable exceeds with probability alpha."""
    # the tail above f is I_y(d2/2, d1/2) with y = d2 / (d2 + d1 f); search log y, then map back
    tail = lambda t: _log_beta_tail(math.exp(t), d2 / 2, d1 / 2)
    if alpha < 0.5:
        y = _bisect(tail, math.log(alpha), -2000.0, 0.0)
        return d2 * (-math.expm1(y)) / (d1 * math.exp(y))
    x = math.exp(_bisect(lambda t: _log_beta_tail(math.exp(t), d1 / 2, d2 / 2), math.log1p(-alpha) if alpha < 1 else -math.inf, -2000.0, 0.0))
    return d2 * x / (d1 * (1 - x))


def _log_gamma_upper(a: float, x: float) -> float:
    """log of the regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 0.0
    lead = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        total = term = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        lower = math.exp(lead) * total
        return math.log1p(-lower) if lower < 1 else -math.inf
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return lead + math.log(h)


def chi2_upper(alpha: float, freedom: float) -> float:
    """The value that a chi-square variable exceeds with probability alpha."""
    high = freedom + 10
    while _log_gamma_upper(freedom / 2, high / 2) > math.log(alpha):
        high *= 2
    return _bisect(lambda x: -_log_gamma_upper(freedom / 2, x / 2), -math.log(alpha), 0.0, high)


def normal_upper(alpha: float) -> float:
    """The value that a standard normal variable exceeds with probability alpha."""
    return -NormalDist().inv_cdf(alpha)
