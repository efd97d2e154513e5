"""Areas of disks and annuli cut by rectangles, points in regions, affine maps: Column expressions and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[float, float, float, float]


def corner_area(r: Column, x: Column, y: Column) -> Column:
    """Area of the disk of radius r about the origin within [0, x] x [0, y], x and y >= 0."""
    x, y = F.least(x, r), F.least(y, r)
    part = lambda t: 0.5 * (t * F.sqrt(F.greatest(F.lit(0.0), r * r - t * t)) + r * r * F.asin(F.least(F.lit(1.0), t / r)))
    from_x = F.sqrt(F.greatest(F.lit(0.0), r * r - y * y))
    return F.when(x * x + y * y <= r * r, x * y).otherwise(y * from_x + part(x) - part(from_x))


def disk_rect_area(x: Column, y: Column, r: Column, box: Box) -> Column:
    """Area of the disk about (x, y) within the rectangle, in closed form by signed corners."""

    def corner(dx: Column, dy: Column) -> Column:
        return F.signum(dx) * F.signum(dy) * corner_area(r, F.abs(dx), F.abs(dy))

    x0, y0, x1, y1 = (F.lit(float(v)) for v in box)
    return corner(x1 - x, y1 - y) - corner(x0 - x, y1 - y) - corner(x1 - x, y0 - y) + corner(x0 - x, y0 - y)


def annulus_rect_area(x: Column, y: Column, inner: Column, outer: Column, box: Box) -> Column:
    """Area of a ring within the rectangle."""
    return disk_rect_area(x, y, outer, box) - F.when(inner > 0, disk_rect_area(x, y, F.greatest(inner, F.lit(1e-300)), box)).otherwise(0.0)


def annulus_areas(x: Column, y: Column, r_max: float, bins: int, box: Box) -> Column:
    """Areas of all rings of equal width up to r_max within the rectangle, as an array."""
    d = r_max / bins
    return F.array(*[annulus_rect_area(x, y, F.lit(k * d), F.lit((k + 1) * d), box) for k in range(bins)])


def in_box(x: Column, y: Column, box: Box) -> Column:
    """Inside the closed rectangle."""
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def in_polygon(x: Column, y: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Even-odd test against rings of vertices, the last joined to the first; bounded by the polygon, which is part of the plan."""
    crossings = F.lit(0)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if ay == by:
                continue
            spans = (F.lit(ay) > y) != (F.lit(by) > y)
            crossings = crossings + F.when(spans & (x < (bx - ax) * (y - ay) / (by - ay) + ax), 1).otherwise(0)
    return crossings % 2 == 1


def ring_area(ring: list[tuple[float, float]]) -> float:
    """Signed area of a ring of vertices."""
    return sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def oriented(rings: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Rings turned so that outer ones run counter-clockwise and holes clockwise, by how many others hold their first vertex."""
    def holds(ring, x, y):
        cuts = [(bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True) if (ay > y) != (by > y)]
        return sum(c > x for c in cuts) % 2 == 1

    depth = [sum(holds(other, *ring[0]) for other in rings if other is not ring) for ring in rings]
    return [ring if (ring_area(ring) > 0) == (d % 2 == 0) else ring[::-1] for ring, d in zip(rings, depth, strict=True)]


def disk_polygon_area(x: Column, y: Column, r: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Area of the disk about (x, y) within a polygon: for each edge the signed part of the disk in the triangle of its ends
    and the centre, which is a triangle between the points where the edge cuts the circle and sectors outside them."""
    total = F.lit(0.0)
    turn = lambda p, q: F.atan2(p[0] * q[1] - p[1] * q[0], p[0] * q[0] + p[1] * q[1])
    for ring in oriented(rings):
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            dx, dy = bx - ax, by - ay
            n = dx * dx + dy * dy
            if n == 0:
                continue
            a, b = (ax - x, ay - y), (bx - x, by - y)
            middle = -(a[0] * dx + a[1] * dy) / n
            inside = middle * middle - (a[0] * a[0] + a[1] * a[1] - r * r) / n
            half = F.sqrt(F.greatest(inside, F.lit(0.0)))
            clamp = lambda t: F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
            at = lambda t, a=a, dx=dx, dy=dy: (a[0] + t * dx, a[1] + t * dy)
            p, q = at(clamp(middle - half)), at(clamp(middle + half))
            total = total + 0.5 * (r * r * (turn(a, p) + turn(q, b)) + (p[0] * q[1] - p[1] * q[0]))
    return total


def check_simple(rings: list[list[tuple[float, float]]]) -> None:
    """Raises ValueError if two edges that are not neighbours cross."""
    edges = [(r, i, a, b) for r, ring in enumerate(rings) for i, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1], strict=True))]
    side = lambda a, b, p: math.copysign(1, v) if (v := (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])) else 0
    for n, (_, _, a, b) in enumerate(edges):
        for _, _, c, d in edges[:n]:
            if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
                raise ValueError("rings cross")


def compose(first: tuple[float, ...], second: tuple[float, ...]) -> tuple[float, ...]:
    """The affine map (a, b, c, d, e, f): x' = a x + b y + c, y' = d x + e y + f, that applies one map and then another."""
    a, b, c, d, e, f = second
    g, h, i, j, k, m = first
    return (a * g + b * j, a * h + b * k, a * i + b * m + c, d * g + e * j, d * h + e * k, d * i + e * m + f)


def inverse(m: tuple[float, ...]) -> tuple[float, ...] | None:
    """The inverse map, or None if the determinant is below 1e-12."""
    a, b, c, d, e, f = m
    det = a * e - b * d
    if abs(det) < 1e-12:
        return None
    return (e / det, -b / det, (b * f - c * e) / det, -d / det, a / det, (c * d - a * f) / det)


def mapped(m: tuple[float, ...], x: Column, y: Column) -> tuple[Column, Column]:
    """The point under the map."""
    return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]


def corner_sql(r: str, x: str, y: str) -> str:
    x, y = f"least({x}, {r})", f"least({y}, {r})"
    s = f"sqrt(greatest(0, {r}*{r} - {y}*{y}))"
    part = lambda t: f"0.5*({t}*sqrt(greatest(0, {r}*{r} - {t}*{t})) + {r}*{r}*asin(least(1.0, {t}/{r})))"
    return f"(case when {x}*{x} + {y}*{y} <= {r}*{r} then {x}*{y} else {y}*{s} + {part(x)} - {part(s)} end)"


def disk_rect_sql(x: str, y: str, r: str, box: Box) -> str:
    c = lambda bx, by: f"sign({bx} - {x})*sign({by} - {y})*{corner_sql(r, f'abs({bx} - {x})', f'abs({by} - {y})')}"
    return f"({c(box[2], box[3])} - {c(box[0], box[3])} - {c(box[2], box[1])} + {c(box[0], box[1])})"
