"""Kernels, units, parameter warps, colour, memberships: scalar functions as Column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Micrometres in a unit.
UNITS = {
    "nanometer": 1e-3, "nanometre": 1e-3, "nm": 1e-3, "micrometer": 1.0, "micrometre": 1.0, "micron": 1.0, "um": 1.0, "µm": 1.0, "μm": 1.0,
    "millimeter": 1e3, "millimetre": 1e3, "mm": 1e3, "centimeter": 1e4, "centimetre": 1e4, "cm": 1e4, "meter": 1e6, "metre": 1e6, "m": 1e6,
    "inch": 25400.0, "in": 25400.0,
}


def kernel(d2: Column, r: float, degree: int | str) -> Column:
    """Unit-mass kernel at a squared distance: (n + 1) / (pi r^2) (1 - t)^n with t = d2 / r^2, or "gaussian" with sigma r / 3 cut at r."""
    t = d2 / (r * r)
    if degree == "gaussian":
        s2 = (r / 3) ** 2
        mass = 2 * math.pi * s2 * (1 - math.exp(-(r * r) / (2 * s2)))
        return F.when(t < 1, F.exp(-d2 / (2 * s2)) / mass).otherwise(0.0)
    shape = F.lit(1.0) if degree == 0 else F.pow(F.greatest(F.lit(0.0), 1 - t), F.lit(float(degree)))
    return F.when(t < 1, shape * ((degree + 1) / (math.pi * r * r))).otherwise(0.0)


def moment2(r: float, degree: int | str) -> float:
    """Second moment of a kernel."""
    if degree == "gaussian":
        s2 = (r / 3) ** 2
        q = r * r / (2 * s2)
        return 2 * s2 * (1 - math.exp(-q) * (1 + q)) / (1 - math.exp(-q))
    return r * r / (degree + 2)


def roughness(r: float, degree: int | str) -> float:
    """Integral of the squared kernel."""
    if degree == "gaussian":
        s2 = (r / 3) ** 2
        mass = 2 * math.pi * s2 * (1 - math.exp(-(r * r) / (2 * s2)))
        return math.pi * s2 * (1 - math.exp(-(r * r) / s2)) / mass**2
    return (degree + 1) ** 2 / ((2 * degree + 1) * math.pi * r * r)


def equivalent_radius(base: float, degree: int | str, base_degree: int | str = 0) -> float:
    """Radius at which a kernel has the second moment of another of radius ``base``."""
    return base * math.sqrt(moment2(1.0, base_degree) / moment2(1.0, degree))


def unit_factor(unit: Column) -> Column:
    """Micrometres in a unit, whatever its case; null if it is unknown."""
    table = F.create_map(*[F.lit(v) for pair in UNITS.items() for v in pair])
    return F.try_element_at(table, F.lower(F.trim(unit)))


def convert(value: Column, source: Column, target: Column) -> Column:
    return value * unit_factor(source) / unit_factor(target)


def warp(u: Column, lo: float, hi: float, kind: str = "lin", step: float = 0.0) -> Column:
    """A control's place from 0 to 1 on its scale: lin, exp (bounds of one sign), amp (squared) or db (0 to 1 as decibels, silent at 0)."""
    u = F.least(F.lit(1.0), F.greatest(F.lit(0.0), u))
    if kind == "exp":
        out = lo * F.pow(F.lit(hi / lo), u)
    elif kind == "amp":
        out = lo + (hi - lo) * u * u
    else:
        out = lo + (hi - lo) * u
    return F.round(out / step) * step if step else out


def unwarp(v: Column, lo: float, hi: float, kind: str = "lin") -> Column:
    """The place from 0 to 1 of a value."""
    if kind == "exp":
        out = F.log(v / lo) / math.log(hi / lo)
    elif kind == "amp":
        out = F.sqrt(F.greatest(F.lit(0.0), (v - lo) / (hi - lo)))
    else:
        out = (v - lo) / (hi - lo)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def membership_to_distance(mu: Column, log: bool = False, eps: float = 1e-6) -> Column:
    return -F.log(F.greatest(mu, F.lit(eps or 1e-6))) if log else 1.0 - mu


def cell_center(col: Column, row: Column, box: tuple[float, float, float, float], width: int, height: int) -> tuple[Column, Column]:
    """World coordinates of a pixel's centre, row 0 at the top."""
    return box[0] + (col + 0.5) * ((box[2] - box[0]) / width), box[3] - (row + 0.5) * ((box[3] - box[1]) / height)


def raster_size(span_x: float, span_y: float, radius: float, per_radius: float = 3.0, least: int = 16, most: int = 2048) -> tuple[int, int]:
    """Pixels of a raster that resolves a radius."""
    side = lambda s: min(most, max(least, math.ceil(s * per_radius / radius)))
    return side(span_x), side(span_y)


#: Linear sRGB to cone responses, and those to Oklab.
_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))


def oklab(r: Column, g: Column, b: Column) -> list[Column]:
    """L, a, b of sRGB from 0 to 1."""
    linear = [F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4))) for c in (r, g, b)]
    cones = [F.cbrt(sum((w * c for w, c in zip(m[1:], linear[1:], strict=True)), m[0] * linear[0])) for m in _LMS]
    return [sum((w * c for w, c in zip(m[1:], cones[1:], strict=True)), m[0] * cones[0]) for m in _LAB]


def oklab_sql(r: str, g: str, b: str) -> list[str]:
    linear = [f"(case when {c} <= 0.04045 then {c} / 12.92 else pow(({c} + 0.055) / 1.055, 2.4) end)" for c in (r, g, b)]
    cones = [f"cbrt({' + '.join(f'{w!r} * {c}' for w, c in zip(m, linear, strict=True))})" for m in _LMS]
    return [" + ".join(f"({w!r}) * {c}" for w, c in zip(m, cones, strict=True)) for m in _LAB]


def mapped_srgb(light: np.ndarray, chroma: np.ndarray, hue: np.ndarray) -> np.ndarray:
    """sRGB, rows of three from 0 to 1, of polar Oklab colours; what is outside the gamut loses chroma until it is inside."""
    lms, lab = np.linalg.inv(np.array(_LMS)), np.linalg.inv(np.array(_LAB))

    def linear(c: np.ndarray) -> np.ndarray:
        return (np.stack([light, c * np.cos(hue), c * np.sin(hue)], 1) @ lab.T) ** 3 @ lms.T

    inside = lambda c: ((linear(c) >= -1e-6) & (linear(c) <= 1 + 1e-6)).all(1)
    low, high = np.zeros_like(chroma), chroma.copy()
    for _ in range(24):
        middle = (low + high) / 2
        good = inside(middle)
        low, high = np.where(good, middle, low), np.where(good, high, middle)
    rgb = np.clip(linear(np.where(inside(chroma), chroma, low)), 0, 1)
    return np.where(rgb <= 0.0031308, 12.92 * rgb, 1.055 * rgb ** (1 / 2.4) - 0.055)


def diverging(t: Column, negative: float = math.radians(250), positive: float = math.radians(29), centre: float = 0.97, end: float = 0.55, chroma: float = 0.15) -> Column:
    """A ramp over [-1, 1] as [r, g, b]: lightness and chroma follow |t|, so both signs stand out alike; the hue is the sign's."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        x = np.clip(x.to_numpy(float), -1, 1)
        size = np.abs(x)
        return pd.Series(list(mapped_srgb(centre + (end - centre) * size, chroma * size, np.where(x < 0, negative, positive))))

    return run(t)


def sequential(t: Column, hue: float, dark: float = 0.14, bright: float = 0.86, chroma: float = 0.15) -> Column:
    """A ramp over [0, 1] at one hue as [r, g, b]: lighter and more colourful towards 1."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        x = np.clip(x.to_numpy(float), 0, 1)
        return pd.Series(list(mapped_srgb(dark + (bright - dark) * x, chroma * x**0.4, np.full(len(x), hue))))

    return run(t)
