"""Distribution functions for p-values, on plain floats (scipy is not needed)."""

from __future__ import annotations

import math


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """Inverse of normal_cdf, by bisection and Newton steps."""
    lo, hi = -40.0, 40.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * front)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= (step := d * c)
        if abs(step - 1) < 1e-15:
            break
    return max(0.0, 1 - h * front)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            h *= (step := d * c)
        if abs(step - 1) < 1e-15:
            break
    return min(1.0, front * h)


def chi2_sf(x: float, df: float) -> float:
    return 1 - gamma_p(df / 2, x / 2) if x > 0 else 1.0


def chi2_quantile(p: float, df: float) -> float:
    lo, hi = 0.0, df + 40 * math.sqrt(2 * df) + 40
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_p(df / 2, mid / 2) < p else (lo, mid)
    return (lo + hi) / 2


def t_two_sided(t: float, df: float) -> float:
    return beta_i(df / 2, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def ks_two_sample_p(d: float, n: int, m: int) -> float:
    """Asymptotic p-value of the two-sample Kolmogorov-Smirnov statistic."""
    x = math.sqrt(n * m / (n + m)) * d
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 101))))
