"""Bessel functions and spectra of kernels, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points of the trapezoid rule; for a periodic integrand its error falls faster than any power of their number.
POINTS = 128


def bessel_j(order: int, x: Column) -> Column:
    """J of a whole order, by Bessel's integral over a full turn: the mean of cos(order t - x sin t). For |x| up to 100."""
    turn = lambda k: k * (2 * math.pi / POINTS)
    return F.aggregate(F.sequence(F.lit(0), F.lit(POINTS - 1)), F.lit(0.0), lambda s, k: s + F.cos(order * turn(k) - x * F.sin(turn(k)))) / float(POINTS)


def bessel_sql(order: int | str, x: str) -> str:
    """The same in DuckDB SQL."""
    return f"(list_sum(list_transform(range({POINTS}), lambda k: cos({order} * k * {2 * math.pi / POINTS!r} - ({x}) * sin(k * {2 * math.pi / POINTS!r}))) ) / {POINTS}.0)"


def kernel_spectrum(degree: int, z: Column) -> Column:
    """Radial transform of a polynomial kernel at z = frequency times radius, 1 at z = 0. Below z = 1, where the closed form
    divides two small numbers, its power series is summed."""
    n = degree
    closed = (n + 1) * 2.0 ** (n + 1) * math.factorial(n) * bessel_j(n + 1, z) / F.pow(z, F.lit(float(n + 1)))
    series, term = F.lit(0.0), 1.0
    for k in range(8):
        series = series + F.pow(z * z / 4, F.lit(float(k))) * term
        term *= -1.0 / ((k + 1) * (k + n + 2))
    return F.when(F.abs(z) < 1, series).otherwise(closed)
