"""Number semantics: halves round towards positive infinity, values stay doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(value: Column, digits: int) -> Column:
    """``floor(x * 10^d + 0.5) / 10^d``; unlike ``round`` it sends -2.25 to -2.2."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def round1(value: Column) -> Column:
    return round_half_up(value, 1)


def round4(value: Column) -> Column:
    return round_half_up(value, 4)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def saturating(value: Column, half: float) -> Column:
    """x / (x + half), zero for anything not positive."""
    return F.when(value > 0, value / (value + F.lit(half))).otherwise(F.lit(0.0))
