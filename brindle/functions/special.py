"""Numbers on the driver, for small result tables: tail probabilities and step-up adjustment."""

from __future__ import annotations

import math

import numpy as np


def _gamma_upper(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function, by its series or its continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / (c if abs(c) > tiny else tiny)
        step = d * c
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return front * h


def chi_square_tail(statistic: float, freedom: int) -> float:
    return _gamma_upper(freedom / 2, statistic / 2)


def step_up(p: list[float | None]) -> list[float | None]:
    """Benjamini-Hochberg adjusted values of those that are there."""
    there = [i for i, x in enumerate(p) if x is not None and math.isfinite(x)]
    order = sorted(there, key=lambda i: p[i])
    out: list[float | None] = [None] * len(p)
    least = 1.0
    for rank in range(len(order), 0, -1):
        i = order[rank - 1]
        least = min(least, p[i] * len(order) / rank)
        out[i] = least
    return out


def finite(x) -> bool:
    return isinstance(x, (int, float, np.number)) and not isinstance(x, bool) and math.isfinite(x)
