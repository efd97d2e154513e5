"""Point patterns and manifolds with known truths, scenes for kernels, volumes: generated row by row.

Every coordinate is a hash of the row's number and the seed, so a generator needs no shuffle, gives the same rows however
they are dealt, and makes as many as are asked for. Numbers of points are Poisson draws.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators.lattice import Box
from quadrille.operators.populations import gauss, uniform
from quadrille.operators.range_join import self_pairs

WINDOW: Box = (0.0, 0.0, 1000.0, 1000.0)


def _rows(spark: SparkSession, n: float, types: int, seed: int) -> DataFrame:
    """Rows of all types: id, type_id. A Poisson number of each, with mean n."""
    counts = np.random.Generator(np.random.PCG64(seed)).poisson(n, types)
    ends = np.cumsum(counts)
    kind = F.lit(0)
    for end in ends[:-1].tolist():
        kind = kind + (F.col("id") >= end).cast("int")
    return spark.range(int(ends[-1])).withColumn("type_id", kind)


def _anywhere(box: Box, key: str | Column, seed: int, salt: int) -> tuple[Column, Column]:
    return box[0] + uniform(key, salt, seed) * (box[2] - box[0]), box[1] + uniform(key, salt + 1, seed) * (box[3] - box[1])


def _finished(points: DataFrame, box: Box) -> DataFrame:
    inside = F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3])
    return points.where(inside).select(F.col("id").alias("cell_id"), "x", "y", F.col("type_id").cast("int").alias("type_id"))


def csr(spark, n=1500.0, seed=0, box=WINDOW, types=2) -> DataFrame:
    """Points anywhere, independent: g = 1."""
    rows = _rows(spark, n, types, seed)
    x, y = _anywhere(box, "id", seed, 10)
    return _finished(rows.withColumns({"x": x, "y": y}), box)


def _clustered(spark, n, seed, box, types, group: Callable[[Column], Column], sigma: float, parents: int) -> DataFrame:
    """Points about parents that the types of a group share. Parents lie in a window widened by four sigma; their places
    are hashes of their numbers, so no join is needed."""
    wide = (box[0] - 4 * sigma, box[1] - 4 * sigma, box[2] + 4 * sigma, box[3] + 4 * sigma)
    share = (wide[2] - wide[0]) * (wide[3] - wide[1]) / ((box[2] - box[0]) * (box[3] - box[1]))
    held = _rows(spark, n * share, types, seed)
    held = held.withColumn("_p", group(F.col("type_id")) * 1_000_003 + F.floor(uniform("id", 20, seed) * max(1, round(parents * share))))
    px, py = _anywhere(wide, "_p", seed, 30)
    return _finished(held.withColumns({"x": px + sigma * gauss("id", 40, seed), "y": py + sigma * gauss("id", 50, seed)}), box)


def thomas(spark, n=1500.0, seed=0, box=WINDOW, types=2, sigma=30.0, parents=40) -> DataFrame:
    """All types about the same parents: g = 1 + exp(-r^2 / 4 sigma^2) / (4 pi sigma^2 kappa) for all pairs."""
    return _clustered(spark, n, seed, box, types, lambda t: F.lit(0), sigma, parents)


def independent_clustered(spark, n=1500.0, seed=0, box=WINDOW, types=2, sigma=30.0, parents=40) -> DataFrame:
    """Each type about parents of its own: that g within a type, 1 across."""
    return _clustered(spark, n, seed, box, types, lambda t: t, sigma, parents)


def guilds(spark, n=1500.0, seed=0, box=WINDOW, types=6, sigma=30.0, parents=40, groups=3) -> DataFrame:
    """Types in groups that share parents: that g within a group, 1 across."""
    return _clustered(spark, n, seed, box, types, lambda t: t % groups, sigma, parents)


def colocalised(spark, n=1500.0, seed=0, box=WINDOW, types=2, sigma=25.0) -> DataFrame:
    """Type 0 anywhere, every other point near one of type 0: cross g = 1 + exp(-r^2 / 2 sigma^2) / (2 pi sigma^2 lambda)."""
    rows = _rows(spark, n, types, seed)
    anchors = max(1, int(np.random.Generator(np.random.PCG64(seed)).poisson(n, types)[0]))
    near = F.floor(uniform("id", 60, seed) * anchors).cast("long")
    held = rows.withColumn("_p", F.when(F.col("type_id") == 0, F.col("id")).otherwise(near))
    x, y = _anywhere(box, "_p", seed, 10)
    moved = F.when(F.col("type_id") == 0, 0.0).otherwise(sigma)
    return _finished(held.withColumns({"x": x + moved * gauss("id", 40, seed), "y": y + moved * gauss("id", 50, seed)}), box)


def segregated(spark, n=1500.0, seed=0, box=WINDOW, types=2, bands=4, gap=40.0) -> DataFrame:
    """Types in bands of their own with a gap between: cross g = 0 below the gap."""
    rows = _rows(spark, n, types, seed)
    width = (box[2] - box[0]) / (bands * types)
    if width <= gap:
        raise ValueError("the gap is as wide as a band")
    band = F.floor(uniform("id", 70, seed) * bands) * types + F.col("type_id")
    x = box[0] + band * width + gap / 2 + uniform("id", 71, seed) * (width - gap)
    return _finished(rows.withColumns({"x": x, "y": _anywhere(box, "id", seed, 10)[1]}), box)


def hardcore(spark, n=1500.0, seed=0, box=WINDOW, types=2, core=8.0) -> DataFrame:
    """No two points nearer than the core: of two that are, the later number goes. g = 0 below the core; fewer points than asked."""
    points = csr(spark, n, seed, box, types)
    gone = self_pairs(points.select("cell_id", "x", "y"), core, "cell_id").select(F.greatest("a_cell_id", "b_cell_id").alias("cell_id")).distinct()
    return points.join(gone, "cell_id", "left_anti").select("cell_id", "x", "y", "type_id")


def gradient(spark, n=1500.0, seed=0, box=WINDOW, types=2) -> DataFrame:
    """Independent types that both grow denser along x: they share a trend, not places."""
    rows = _rows(spark, n, types, seed)
    x = box[0] + F.sqrt(uniform("id", 10, seed)) * (box[2] - box[0])
    return _finished(rows.withColumns({"x": x, "y": _anywhere(box, "id", seed, 10)[1]}), box)


PATTERNS = {f.__name__: f for f in (csr, thomas, colocalised, segregated, independent_clustered, guilds, hardcore, gradient)}


def point_pattern(spark: SparkSession, key: str, **options) -> DataFrame:
    """A pattern by name: cell_id, x, y, type_id."""
    if key not in PATTERNS:
        raise KeyError(f"no pattern is named {key}; known: {', '.join(PATTERNS)}")
    return PATTERNS[key](spark, **options)


def association_scene(spark: SparkSession, seed: int = 0, extent: float = 1000.0, patches: int = 6, radius: float = 60.0, per_patch: int = 90, background: int = 400, inside: int = 150, outside: int = 350) -> DataFrame:
    """Cells of B (type 1) in patches and about them, cells of A (type 0) placed in patches or anywhere: cell_id, x, y, type_id, associated."""
    n_b, n_a = patches * per_patch + background, inside + outside
    i = F.col("id")
    rows = spark.range(n_b + n_a)
    in_patch = (i < patches * per_patch) | ((i >= n_b) & (i < n_b + inside))
    which = F.when(i < n_b, F.floor(i / per_patch)).otherwise(F.floor(uniform("id", 80, seed) * patches)).cast("long")
    keep = 1.5 * radius
    centre = [keep + uniform(which, 90 + k, seed) * (extent - 2 * keep) for k in (0, 1)]
    turn, out = uniform("id", 81, seed) * (2 * math.pi), radius * F.sqrt(uniform("id", 82, seed))
    free = [uniform("id", 83 + k, seed) * extent for k in (0, 1)]
    x = F.when(in_patch, centre[0] + out * F.cos(turn)).otherwise(free[0])
    y = F.when(in_patch, centre[1] + out * F.sin(turn)).otherwise(free[1])
    return rows.select(i.alias("cell_id"), x.alias("x"), y.alias("y"), (i < n_b).cast("int").alias("type_id"), ((i >= n_b) & in_patch).alias("associated"))


def _turned(t: Column) -> tuple[Column, Column]:
    return F.cos(t), F.sin(t)


def manifold(spark: SparkSession, key: str, n: int = 1000, seed: int = 0) -> DataFrame:
    """Points of a known shape: id, v (coordinates), label, t (place along the shape, null where there is none)."""
    u = lambda k: uniform("id", 100 + k, seed)
    g = lambda k: gauss("id", 200 + 10 * k, seed)
    label, t = F.lit(0), F.lit(None).cast("double")
    if key == "blobs":
        label = F.floor(u(0) * 5)
        v = [F.cos(label * 1.2566) * 6 + g(0), F.sin(label * 1.2566) * 6 + g(1), g(2)]
    elif key == "branching":
        label, t = F.floor(u(0) * 3), u(1)
        turn = label * (2 * math.pi / 3)
        v = [t * F.cos(turn) * 10 + 0.3 * g(0), t * F.sin(turn) * 10 + 0.3 * g(1), 0.3 * g(2)]
    elif key == "swissRoll":
        t = 1.5 * math.pi * (1 + 2 * u(0))
        v = [t * F.cos(t), 21 * u(1), t * F.sin(t)]
    elif key == "linkedRings":
        label, t = F.floor(u(0) * 2), u(1) * 2 * math.pi
        c, s = _turned(t)
        v = [F.when(label == 0, c).otherwise(1 + c), F.when(label == 0, s).otherwise(0.0), F.when(label == 0, 0.0).otherwise(s)]
        v = [x + 0.02 * g(k) for k, x in enumerate(v)]
    elif key == "sphere":
        z, turn = 2 * u(0) - 1, u(1) * 2 * math.pi
        flat = F.sqrt(1 - z * z)
        v = [flat * F.cos(turn), flat * F.sin(turn), z]
    elif key == "hierarchy":
        label = F.floor(u(0) * 9)
        big, small = F.floor(label / 3), label % 3
        c, s = _turned(big * 2.0944)
        d, e = _turned(small * 2.0944)
        v = [12 * c + 3 * d + 0.5 * g(0), 12 * s + 3 * e + 0.5 * g(1), 0.5 * g(2)]
    elif key == "cellCycle":
        t = u(0) * 2 * math.pi
        c, s = _turned(t)
        label, v = F.floor(u(0) * 4), [5 * c + 0.4 * g(0), 5 * s + 0.4 * g(1), 0.4 * g(2)]
    elif key == "rarePopulation":
        label = (u(0) < 0.02).cast("int")
        v = [8.0 * label + g(0), g(1), g(2)]
    elif key == "uniformNoise":
        v = [u(k) for k in range(3)]
    else:
        raise KeyError(f"no manifold is named {key}; known: {', '.join(MANIFOLDS)}")
    return spark.range(n).select("id", F.array(*v).cast("array<double>").alias("v"), label.cast("int").alias("label"), t.alias("t"))


#: Names of the manifolds.
MANIFOLDS = ("blobs", "branching", "swissRoll", "linkedRings", "sphere", "hierarchy", "cellCycle", "rarePopulation", "uniformNoise")


def expressed(points: DataFrame, dims: int = 3, per_axis: int = 10, noise: float = 0.1, seed: int = 0) -> DataFrame:
    """Coordinates as expression: id, v with ``per_axis`` genes for each axis, each a baseline (0 to 0.4) and a loading (0.6 to
    1.4) of the axis scaled to 0 to 1, with normal noise."""
    ends = points.agg(*[f(F.get("v", F.lit(k))).alias(f"{n}{k}") for k in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    rng = np.random.Generator(np.random.PCG64(seed))
    genes = []
    for k in range(dims):
        low, high = ends[f"lo{k}"] or 0.0, ends[f"hi{k}"] or 0.0
        axis = (F.get("v", F.lit(k)) - low) / (high - low or 1.0)
        genes += [float(rng.uniform(0, 0.4)) + float(rng.uniform(0.6, 1.4)) * axis + noise * gauss("id", 1000 + 10 * (k * per_axis + g), seed) for g in range(per_axis)]
    return points.select("id", F.array(*genes).alias("v"))


def gray_scott_seed(spark: SparkSession, width: int, height: int, jitter: float = 0.0) -> DataFrame:
    """u 1 and v 0 with a square of u 0.5, v 0.25 in the middle; jitter of v is a hash of the pixel: row, col, u, v."""
    reach = max(2, min(width, height) // 10)
    row, col = F.floor(F.col("id") / width).cast("int"), (F.col("id") % width).cast("int")
    middle = (F.abs(row - height // 2) <= reach) & (F.abs(col - width // 2) <= reach)
    seeded = F.when(middle, 0.25).otherwise(0.0)
    if jitter > 0:
        shift = F.pmod(F.col("id") * 2654435761, F.lit(1 << 32)) / float((1 << 32) - 1) - 0.5
        seeded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), seeded + shift * jitter))
    return spark.range(width * height).select(row.alias("row"), col.alias("col"), F.when(middle, 0.5).otherwise(1.0).alias("u"), seeded.alias("v"))


def _escape(step: Callable, start: tuple[Column, ...], most: int) -> Column:
    """Steps of a map until its point leaves the ball of radius 2, as a share of ``most``; the map runs inside one expression."""
    first = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(start)], F.lit(0).alias("n"))
    out = lambda s: sum((s[f"c{i}"] * s[f"c{i}"] for i in range(1, len(start))), s["c0"] * s["c0"]) > 4
    go = lambda s: F.struct(*[c.alias(f"c{i}") for i, c in enumerate(step(s))], (s["n"] + 1).alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), first, lambda s, _: F.when(out(s), s).otherwise(go(s)), lambda s: s["n"] / float(most))


def mandelbrot(spark: SparkSession, side: int, box: Box = (-2.0, -1.25, 0.5, 1.25), most: int = 32) -> DataFrame:
    """An escape-time raster, row 0 at the top: row, col, v."""
    row, col = F.floor(F.col("id") / side).cast("int"), (F.col("id") % side).cast("int")
    held = spark.range(side * side).select(row.alias("row"), col.alias("col"))
    x, y = box[0] + (F.col("col") + 0.5) * (box[2] - box[0]) / side, box[3] - (F.col("row") + 0.5) * (box[3] - box[1]) / side
    held = held.withColumns({"x": x, "y": y})
    zero = F.lit(0.0)
    v = _escape(lambda s: (s["c0"] * s["c0"] - s["c1"] * s["c1"] + F.col("x"), 2 * s["c0"] * s["c1"] + F.col("y")), (zero, zero), most)
    return held.select("row", "col", v.alias("v"))


def mandelbulb(spark: SparkSession, side: int, region: tuple[float, ...] = (-1.2, -1.2, -1.2, 1.2, 1.2, 1.2), most: int = 8, power: float = 8.0) -> DataFrame:
    """An escape-time volume: ix, iy, iz, v. A point turns by ``power`` times its two angles and its radius to that power."""
    n = side * side * side
    at = lambda c, k: region[k] + (F.col(c) + 0.5) * (region[k + 3] - region[k]) / side
    held = spark.range(n).select((F.col("id") % side).cast("int").alias("ix"), (F.floor(F.col("id") / side) % side).cast("int").alias("iy"), F.floor(F.col("id") / (side * side)).cast("int").alias("iz"))
    held = held.withColumns({"x": at("ix", 0), "y": at("iy", 1), "z": at("iz", 2)})

    def step(s):
        r = F.sqrt(s["c0"] * s["c0"] + s["c1"] * s["c1"] + s["c2"] * s["c2"])
        tilt, turn = power * F.acos(F.when(r > 0, s["c2"] / r).otherwise(0.0)), power * F.atan2(s["c1"], s["c0"])
        far = F.pow(r, F.lit(power))
        return far * F.sin(tilt) * F.cos(turn) + F.col("x"), far * F.sin(tilt) * F.sin(turn) + F.col("y"), far * F.cos(tilt) + F.col("z")

    return held.select("ix", "iy", "iz", _escape(step, (F.col("x"), F.col("y"), F.col("z")), most).alias("v"))


def pyramid(level0: DataFrame, levels: int) -> DataFrame:
    """A raster and its halvings: level, row, col, v. Each level averages two by two pixels of the one before."""
    out = held = level0.select(F.lit(0).alias("level"), "row", "col", "v")
    for k in range(1, levels):
        held = held.groupBy(F.floor(F.col("row") / 2).cast("int").alias("row"), F.floor(F.col("col") / 2).cast("int").alias("col")).agg(F.avg("v").alias("v")).select(F.lit(k).alias("level"), "row", "col", "v")
        out = out.unionAll(held)
    return out
