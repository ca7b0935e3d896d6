"""Quantiles of the F and chi-squared distributions, from incomplete beta and gamma functions by series and bisection."""

from __future__ import annotations

import math


def gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 0.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= x / k
            total += term
        return lead * total
    return 1 - lead * _fraction(lambda k: (-k * (k - a) if k else 1.0, x + 2 * k + 1 - a))


def _fraction(part, tiny: float = 1e-300) -> float:
    """a0 / (b0 + a1 / (b1 + ...)) by Lentz's method, for part(k) = (a_k, b_k)."""
    value, c, d = tiny, tiny, 0.0
    for k in range(10_000):
        a, b = part(k)
        d = b + a * d or tiny
        c = b + a / c or tiny
        d = 1 / d
        value *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return value


def beta_i(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    lead = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a

    def part(k: int) -> tuple[float, float]:
        m = k // 2
        if k == 0:
            return 1.0, 1.0
        return (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0) if k % 2 == 0 else (-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0)

    return lead * _fraction(part)


def _inverse(cdf, p: float) -> float:
    if not 0 < p < 1:
        raise ValueError("a probability between 0 and 1, please")
    low, high = 0.0, 1.0
    while cdf(high) < p:
        low, high = high, 2 * high
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
    return (low + high) / 2


def chi2_quantile(p: float, df: float) -> float:
    return _inverse(lambda x: gamma_p(df / 2, x / 2), p)


def f_quantile(p: float, d1: float, d2: float) -> float:
    return _inverse(lambda x: beta_i(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2)), p)
