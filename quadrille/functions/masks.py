"""Selections as weights from 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_range(x: Column, lo: float, hi: float, softness: float = 0.0) -> Column:
    """1 inside [lo, hi]; with softness, smooth steps of that half-width at both ends."""
    if softness <= 0:
        return x.between(lo, hi).cast("double")

    def step(edge: float) -> Column:
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - (edge - softness)) / (2 * softness)))
        return t * t * (3 - 2 * t)

    return step(lo) * (1 - step(hi))


def equals(x: Column, code: float, tolerance: float = 0.5) -> Column:
    return (F.abs(x - code) <= tolerance).cast("double")


def threshold(x: Column, at: float = 0.5, soft: bool = False, softness: float = 10.0) -> Column:
    """Step at a value, or a logistic of it; softness 0 counts as 10."""
    if not soft:
        return (x >= at).cast("double")
    return 1.0 / (1.0 + F.exp(-(x - at) * (softness or 10.0)))


def both(a: Column, b: Column) -> Column:
    return F.least(a, b)


def either(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def inverted(a: Column) -> Column:
    return 1.0 - a
