"""Sums of powers as Spark expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms that are added directly before Euler and Maclaurin's formula takes over; its coefficients B(2j) / (2j)!.
DIRECT, COEFFICIENTS = 12, (1 / 12, -1 / 720, 1 / 30240, -1 / 1209600)


def _add(parts: list[Column]) -> Column:
    return reduce(Column.__add__, parts)


def _corrections(alpha: Column, x: Column) -> Column:
    out, rising = [], alpha
    for j, c in enumerate(COEFFICIENTS):
        out.append(c * rising * F.pow(x, -alpha - (2 * j + 1)))
        rising = rising * (alpha + 2 * j + 1) * (alpha + 2 * j + 2)
    return _add(out)


def power_sum(alpha: Column, low: Column, high: Column | None = None) -> Column:
    """The sum of x^-alpha over whole x from ``low`` (1 or more) to ``high``; where ``high`` is absent or null to infinity, which needs alpha > 1."""
    alpha, low = alpha.cast("double"), low.cast("double")
    a = low + DIRECT
    at = F.pow(a, -alpha) / 2 + _corrections(alpha, a)
    endless = F.pow(a, 1 - alpha) / (alpha - 1) + at
    terms = [F.pow(low + i, -alpha) for i in range(DIRECT)]
    if high is None:
        return _add(terms) + endless
    high = high.cast("double")
    between = F.when(F.abs(alpha - 1) < 1e-9, F.log(high) - F.log(a)).otherwise((F.pow(high, 1 - alpha) - F.pow(a, 1 - alpha)) / (1 - alpha))
    bounded = F.when(a <= high, between + at + F.pow(high, -alpha) / 2 - _corrections(alpha, high)).otherwise(0.0)
    head = _add([F.when(low + i > high, 0.0).otherwise(t) for i, t in enumerate(terms)])  # a null bound is no bound
    return head + F.when(high.isNull(), endless).otherwise(bounded)
