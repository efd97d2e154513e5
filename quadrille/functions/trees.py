"""Expression trees and signed distance fields, compiled to Column expressions.

A tree is data (nested tuples), so it can be stored, bred and looked into; compiled, it runs inside the plan.
Expressions: a number, "s", "theta", or (op, a, b) with op add, sub or mul.
Fields: ("sphere", r), ("box", hx, hy, hz), ("plane", nx, ny, nz, d), ("union" | "intersect" | "subtract", a, b),
("smooth_union", a, b, k), ("translate", tx, ty, tz, child), ("scale", f, child), ("displace", child, amp, freq).
"""

from __future__ import annotations

import operator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column, Column]
_OPS = {"add": operator.add, "sub": operator.sub, "mul": operator.mul}


def evaluated(tree, s: Column, theta: Column) -> Column:
    """The value of an expression at (s, theta)."""
    if isinstance(tree, (int, float)):
        return F.lit(float(tree))
    if tree in ("s", "theta"):
        return s if tree == "s" else theta
    op, a, b = tree
    if op not in _OPS:
        raise ValueError(f"no operation is named {op}")
    return _OPS[op](evaluated(a, s, theta), evaluated(b, s, theta))


def ramp(peak: float):
    """From 0 to the peak along s."""
    return "mul", peak, "s"


def linear(a: float, b: float):
    """From a to b along s."""
    return "add", a, ("mul", b - a, "s")


def _length(p: Point) -> Column:
    return F.sqrt(p[0] * p[0] + p[1] * p[1] + p[2] * p[2])


def distance(node, p: Point) -> Column:
    """Signed distance of a point to the field's surface: negative inside. A displaced field only bounds it."""
    kind, *rest = node
    if kind == "sphere":
        return _length(p) - rest[0]
    if kind == "box":
        q = [F.abs(c) - h for c, h in zip(p, rest, strict=True)]
        return _length(tuple(F.greatest(c, F.lit(0.0)) for c in q)) + F.least(F.greatest(*q), F.lit(0.0))
    if kind == "plane":
        *normal, d = rest
        n = sum(c * c for c in normal) ** 0.5 or 1.0
        return reduce(operator.add, [c * w / n for c, w in zip(p, normal, strict=True)]) - d
    if kind in ("union", "intersect", "subtract", "smooth_union"):
        a, b = distance(rest[0], p), distance(rest[1], p)
        if kind == "union":
            return F.least(a, b)
        if kind == "smooth_union":
            h = F.greatest(rest[2] - F.abs(a - b), F.lit(0.0)) / rest[2]
            return F.least(a, b) - h * h * (rest[2] * 0.25)
        return F.greatest(a, b if kind == "intersect" else -b)
    if kind == "translate":
        *by, child = rest
        return distance(child, tuple(c - t for c, t in zip(p, by, strict=True)))
    if kind == "scale":
        factor, child = rest
        return distance(child, tuple(c / factor for c in p)) * factor
    if kind == "displace":
        child, amp, freq = rest
        return distance(child, p) + amp * noise(*[c * freq for c in p])
    raise ValueError(f"no field is named {kind}")


def normal(node, p: Point, eps: float = 1e-4) -> Point:
    """Direction of the field's steepest rise, by central differences."""
    moved = lambda k, d: tuple(c + d if i == k else c for i, c in enumerate(p))
    g = tuple(distance(node, moved(k, eps)) - distance(node, moved(k, -eps)) for k in range(3))
    n = _length(g)
    return tuple(F.when(n > 0, c / n).otherwise(c) for c in g)


def _lattice(ix: np.ndarray, iy: np.ndarray, iz: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 for every corner of the lattice, by arithmetic modulo 2^32."""
    m = (ix * 1619 + iy * 31337 + iz * 6971).astype(np.int64).astype(np.uint32)
    m = m ^ (m << np.uint32(13))
    m = m * (m * m * np.uint32(15731) + np.uint32(789221)) + np.uint32(1376312589)
    return (m & np.uint32(0x7FFFFFFF)).astype(float) / 0x7FFFFFFF


def smooth_noise(p: np.ndarray) -> np.ndarray:
    """Four octaves of lattice noise, each half as strong and twice as fine; within an octave from -1 to 1."""
    total, weight = np.zeros(p.shape[1]), 0.5
    for octave in range(4):
        q = p * 2.0**octave
        low = np.floor(q)
        t = q - low
        t = t * t * t * (t * (t * 6 - 15) + 10)
        value = np.zeros(p.shape[1])
        for corner in range(8):
            bits = [corner >> k & 1 for k in range(3)]
            share = np.prod([t[k] if b else 1 - t[k] for k, b in enumerate(bits)], 0)
            value += share * _lattice(*(low[k] + b for k, b in enumerate(bits)))
        total += weight * (2 * value - 1)
        weight /= 2
    return total


def noise(x: Column, y: Column, z: Column) -> Column:
    """``smooth_noise`` of columns, in batches."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            return pd.Series(smooth_noise(np.stack([a.to_numpy(float), b.to_numpy(float), c.to_numpy(float)])))

    return run(x, y, z)
