"""Tail probabilities of a few distributions, for a handful of numbers per report."""

from __future__ import annotations

import math
from statistics import NormalDist


def _t_tail(t: float, df: float, steps: int = 2000) -> float:
    """P(T > t) for t >= 0, by Simpson's rule on x = sqrt(df) * tan(angle)."""
    start, end = math.atan(t / math.sqrt(df)), math.pi / 2
    width = (end - start) / steps
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)

    def density(angle: float) -> float:
        return scale * max(math.cos(angle), 0.0) ** (df - 1)

    total = density(start) + density(end)
    total += sum((4 if i % 2 else 2) * density(start + i * width) for i in range(1, steps))
    return total * width / 3


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t for p >= 0.5.

    From 1,000 degrees of freedom on by the expansion around the normal quantile, whose next
    term is of the order df ** -5; below, by bisection of the integrated tail.
    """
    if df >= 1000:
        z = NormalDist().inv_cdf(p)
        terms = (
            (z**3 + z) / 4,
            (5 * z**5 + 16 * z**3 + 3 * z) / 96,
            (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
            (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
        )
        return z + sum(term / df ** (i + 1) for i, term in enumerate(terms))
    low, high = 0.0, 1.0
    while _t_tail(high, df) > 1 - p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _t_tail(mid, df) > 1 - p else (low, mid)
    return (low + high) / 2


def chi2_tail(x: float, df: float) -> float:
    """P(X > x) for a chi-squared variable: series or continued fraction."""
    a, z = df / 2, x / 2
    if z <= 0:
        return 1.0
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1 - front * total)
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            return front * h
    raise ArithmeticError(f"the tail of chi-squared at {x} with {df} degrees did not settle")


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_share(1.0 - x, b, a)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 100_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / (1.0 + step * d or tiny)
            c = 1.0 + step / c or tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return front * h / a
    raise ArithmeticError(f"the incomplete beta function at {x}, {a}, {b} did not settle")


def f_tail(x: float, df1: float, df2: float) -> float:
    """P(F > x) for an F variable."""
    return beta_share(df2 / (df2 + df1 * x), df2 / 2, df1 / 2) if x > 0 else 1.0


def t_tail_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|) for Student's t."""
    return beta_share(df / (df + t * t), df / 2, 0.5)
