"""Element algebra: scalars, vectors (arrays), complex numbers struct<re, im> and quaternions struct<w, x, y, z>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p + q)


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p - q)


def scaled(a: Column, s: float) -> Column:
    return F.transform(a, lambda p: p * s)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """Unit vector; a zero vector stays."""
    return F.when(norm(a) > 0, F.transform(a, lambda p: p / norm(a))).otherwise(a)


def cross(a: Column, b: Column) -> Column:
    """Cross product of arrays of three."""
    g = lambda v, i: F.element_at(v, i + 1)
    return F.array(g(a, 1) * g(b, 2) - g(a, 2) * g(b, 1), g(a, 2) * g(b, 0) - g(a, 0) * g(b, 2), g(a, 0) * g(b, 1) - g(a, 1) * g(b, 0))


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def times_complex(a: Column, b: Column) -> Column:
    return complex_of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def quaternion(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.struct(w.alias("w"), x.alias("x"), y.alias("y"), z.alias("z"))


def times_quaternion(a: Column, b: Column) -> Column:
    """The Hamilton product."""
    return quaternion(
        a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"],
        a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"],
        a["w"] * b["y"] - a["x"] * b["z"] + a["y"] * b["w"] + a["z"] * b["x"],
        a["w"] * b["z"] + a["x"] * b["y"] - a["y"] * b["x"] + a["z"] * b["w"],
    )


def conjugate(a: Column, quaternions: bool = False) -> Column:
    return quaternion(a["w"], -a["x"], -a["y"], -a["z"]) if quaternions else complex_of(a["re"], -a["im"])


def magnitude(a: Column, *lanes: str) -> Column:
    """Root of the sum of the squared lanes."""
    total = F.lit(0.0)
    for k in lanes:
        total = total + a[k] * a[k]
    return F.sqrt(total)
