"""Distribution functions without scipy, on numpy arrays: normal, t, chi-square and F."""

from __future__ import annotations

import math

import numpy as np


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            c = 1.0 + step / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_cdf(df / (df + t * t), df / 2.0, 0.5)
    return 1.0 - tail if t > 0 else tail


def f_cdf(x: float, d1: float, d2: float) -> float:
    return beta_cdf(d1 * x / (d1 * x + d2), d1 / 2.0, d2 / 2.0) if x > 0 else 0.0


def gamma_cdf(x: float, a: float) -> float:
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d, c = 1 / (an * d + b), b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1.0 - front * h


def chi2_cdf(x: float, df: float) -> float:
    return gamma_cdf(x / 2.0, df / 2.0)


def quantile(cdf, p: float, low: float, high: float) -> float:
    """The point where an increasing cdf reaches p, by bisection; the bounds widen as needed."""
    while cdf(high) < p:
        high *= 2
    while low < 0 and cdf(low) > p:
        low *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def t_quantile(p: float, df: float) -> float:
    return quantile(lambda x: t_cdf(x, df), p, -10.0, 10.0)


def f_quantile(p: float, d1: float, d2: float) -> float:
    return quantile(lambda x: f_cdf(x, d1, d2), p, 0.0, 10.0)


def vectorised(f):
    """f over arrays, nan where an argument is nan."""
    return lambda *xs: np.array([f(*map(float, x)) if all(v == v for v in x) else math.nan for x in zip(*xs, strict=True)])
