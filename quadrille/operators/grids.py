"""Raster operators on long tables (row, col, v), row 0 at the top; other key columns (such as channel) may be named.

Stencils clamp at the edges. Line stencils collect one raster line into an array: lines are bounded by the raster's side,
and rasters and their lines run in parallel.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.checkpoints import saved


def box_kernel(radius: int) -> list[float]:
    """Ones: a sum, not a mean."""
    return [1.0] * (2 * radius + 1)


def gaussian_kernel(sigma: float, radius: int | None = None) -> list[float]:
    """Normalised weights as far as 3 sigma."""
    radius = math.ceil(3 * sigma) if radius is None else radius
    w = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def along(grid: DataFrame, axis: str, weights: list[float], keys: tuple[str, ...] = (), value: str = "v") -> DataFrame:
    """A clamped stencil along "col" (within rows) or "row"."""
    other = "row" if axis == "col" else "col"
    radius = len(weights) // 2
    lines = grid.groupBy(*keys, other).agg(F.transform(F.sort_array(F.collect_list(F.struct(axis, value))), lambda s: s[value]).alias("line"))
    n = F.size("line")
    at = lambda i, k: F.get("line", F.least(n - 1, F.greatest(F.lit(0), i + k)))

    def stencil(_: Column, i: Column) -> Column:
        total = F.lit(0.0)
        for k, w in zip(range(-radius, radius + 1), weights, strict=True):
            total = total + at(i, k) * w
        return total

    out = lines.select(*keys, other, F.posexplode(F.transform("line", stencil)).alias(axis, value))
    return out.select(*keys, "row", "col", value)


def convolve(grid: DataFrame, weights: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """The separable stencil along both axes."""
    return along(along(grid, "col", weights, keys), "row", weights, keys)


def _extreme(grid: DataFrame, radius: int, least: bool, keys: tuple[str, ...] = ()) -> DataFrame:
    pick = F.min if least else F.max
    over = lambda a, b: Window.partitionBy(*keys, a).orderBy(b).rowsBetween(-radius, radius)
    return grid.withColumn("v", pick("v").over(over("row", "col"))).withColumn("v", pick("v").over(over("col", "row")))


def erode(grid: DataFrame, radius: int, keys: tuple[str, ...] = ()) -> DataFrame:
    return _extreme(grid, radius, True, keys)


def dilate(grid: DataFrame, radius: int, keys: tuple[str, ...] = ()) -> DataFrame:
    return _extreme(grid, radius, False, keys)


def opened(grid: DataFrame, radius: int, keys: tuple[str, ...] = ()) -> DataFrame:
    return dilate(erode(grid, radius, keys), radius, keys)


def closed(grid: DataFrame, radius: int, keys: tuple[str, ...] = ()) -> DataFrame:
    return erode(dilate(grid, radius, keys), radius, keys)


def decimate(grid: DataFrame, factor: int, mode: str = "mean", keys: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of factor x factor pixels reduced by mean, min or max; blocks at the edge use what there is."""
    reduce = {"mean": F.avg, "min": F.min, "max": F.max}[mode]
    return grid.groupBy(*keys, F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(reduce("v").alias("v"))


def neighbour(value: str, axis: str, step: int, keys: tuple[str, ...] = ()) -> Column:
    """The value one step along the axis, the own one at the edge."""
    other = "row" if axis == "col" else "col"
    return F.coalesce(F.lag(value, -step).over(Window.partitionBy(*keys, other).orderBy(axis)), F.col(value))


def slope(value: str, axis: str, keys: tuple[str, ...] = ()) -> Column:
    """Half the difference of both neighbours."""
    return (neighbour(value, axis, 1, keys) - neighbour(value, axis, -1, keys)) * 0.5


def gradient(grid: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return grid.select(*keys, "row", "col", slope("v", "col", keys).alias("gx"), slope("v", "row", keys).alias("gy"))


def laplacian(grid: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    total = neighbour("v", "col", 1, keys) + neighbour("v", "col", -1, keys) + neighbour("v", "row", 1, keys) + neighbour("v", "row", -1, keys) - 4 * F.col("v")
    return grid.select(*keys, "row", "col", total.alias("v"))


def divergence(field: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Of (gx, gy)."""
    return field.select(*keys, "row", "col", (slope("gx", "col", keys) + slope("gy", "row", keys)).alias("v"))


def structure_orientation(grid: DataFrame, radius: int = 2) -> DataFrame:
    """Orientation of the box-averaged structure tensor times its coherence: ox, oy."""
    g = gradient(grid)
    area = float((2 * radius + 1) ** 2)
    mean = lambda e, name: convolve(g.select("row", "col", e.alias("v")), box_kernel(radius)).select("row", "col", (F.col("v") / area).alias(name))
    t = mean(F.col("gx") * F.col("gx"), "xx").join(mean(F.col("gx") * F.col("gy"), "xy"), ["row", "col"]).join(mean(F.col("gy") * F.col("gy"), "yy"), ["row", "col"])
    theta = 0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))
    total = F.col("xx") + F.col("yy")
    spread = F.sqrt((F.col("xx") - F.col("yy")) * (F.col("xx") - F.col("yy")) + 4 * F.col("xy") * F.col("xy"))
    coherence = F.when(total > 1e-12, spread / total).otherwise(0.0)
    return t.select("row", "col", (F.cos(theta) * coherence).alias("ox"), (F.sin(theta) * coherence).alias("oy"))


def channel_tensor(grid: DataFrame) -> DataFrame:
    """Gradient tensor summed over channels; at the edges the difference is divided by the steps there are: xx, xy, yy."""

    def true_slope(axis: str) -> Column:
        other = "row" if axis == "col" else "col"
        w = Window.partitionBy("channel", other).orderBy(axis)
        up, down = F.lead("v").over(w), F.lag("v").over(w)
        steps = up.isNotNull().cast("int") + down.isNotNull().cast("int")
        return F.when(steps > 0, (F.coalesce(up, F.col("v")) - F.coalesce(down, F.col("v"))) / steps).otherwise(0.0)

    g = grid.select("channel", "row", "col", true_slope("col").alias("gx"), true_slope("row").alias("gy"))
    return g.groupBy("row", "col").agg(F.sum(F.col("gx") * F.col("gx")).alias("xx"), F.sum(F.col("gx") * F.col("gy")).alias("xy"), F.sum(F.col("gy") * F.col("gy")).alias("yy"))


def channel_mix(grid: DataFrame, matrix: list[list[float]], offset: list[float]) -> DataFrame:
    """y = M x + b at every pixel: channel, row, col, v."""
    spark = grid.sparkSession
    m = spark.createDataFrame([(c, o, float(w)) for o, line in enumerate(matrix) for c, w in enumerate(line)], "channel int, out int, w double")
    base = spark.createDataFrame([(o, float(b)) for o, b in enumerate(offset)], "out int, b double")
    mixed = grid.join(F.broadcast(m), "channel").groupBy("out", "row", "col").agg(F.sum(F.col("v") * F.col("w")).alias("s"))
    return mixed.join(F.broadcast(base), "out").select(F.col("out").alias("channel"), "row", "col", (F.col("s") + F.col("b")).alias("v"))


def mixture_distance(grid: DataFrame, row: int, col: int) -> DataFrame:
    """Distance over all channels from every pixel to the seed pixel."""
    seed = grid.where((F.col("row") == row) & (F.col("col") == col)).select("channel", F.col("v").alias("s"))
    held = grid.join(F.broadcast(seed), "channel")
    return held.groupBy("row", "col").agg(F.sqrt(F.sum((F.col("v") - F.col("s")) * (F.col("v") - F.col("s")))).alias("v"))


def getis_ord(grid: DataFrame, radius: int = 2) -> DataFrame:
    """Gi* of every pixel: z, and mean and sd of the raster; 0 where the raster is flat."""
    box = convolve(grid, box_kernel(radius)).select("row", "col", F.col("v").alias("s"))
    m = grid.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.count("*").cast("double").alias("n"))
    w = float((2 * radius + 1) ** 2)
    scale = F.col("sd") * F.sqrt(w * (F.col("n") - w) / (F.col("n") - 1))
    return box.crossJoin(F.broadcast(m)).select("row", "col", F.when((F.col("sd") > 0) & (scale > 0), (F.col("s") - F.col("mean") * w) / scale).otherwise(0.0).alias("z"), "mean", "sd")


def flood(mask: DataFrame, row: int, col: int) -> DataFrame:
    """The 4-connected piece of (row, col) pixels that holds the seed: rounds of a join, doubling over finished runs.

    Labels spread as far as a run of pixels in each round (whole line segments at once), until nothing is added."""
    pixels = saved(_runs(mask))
    reached = saved(pixels.where((F.col("row") == row) & (F.col("col") == col)).select("hrun", "vrun"))
    seen = reached
    if not reached.limit(1).count():
        return mask.select("row", "col").limit(0)
    while True:
        h = pixels.join(seen.select("hrun").distinct(), "hrun", "left_semi")
        v = pixels.join(seen.select("vrun").distinct(), "vrun", "left_semi")
        grown = saved(h.select("hrun", "vrun").unionAll(v.select("hrun", "vrun")).distinct())
        if grown.count() == seen.count():
            break
        seen = grown
    return pixels.join(seen, ["hrun", "vrun"], "left_semi").select("row", "col")


def _runs(mask: DataFrame) -> DataFrame:
    """Pixels with names of their horizontal and vertical runs."""
    out = mask.select("row", "col")
    for name, line, axis in (("hrun", "row", "col"), ("vrun", "col", "row")):
        w = Window.partitionBy(line).orderBy(axis)
        out = out.withColumn(name, F.struct(F.col(line).alias("line"), (F.col(axis) - F.row_number().over(w)).alias("k")))
    return out


def _envelope(f: np.ndarray) -> np.ndarray:
    """Least of f[k] + (i - k)^2 over k, at every i, by the lower envelope of the parabolas: linear in their number."""
    known = np.flatnonzero(np.isfinite(f)).tolist()
    if not known:
        return np.full(len(f), np.inf)
    height = {k: f[k] + k * k for k in known}
    hull, starts = [known[0]], [-np.inf]
    for k in known[1:]:
        while True:  # from here on k lies below the last one of the envelope
            start = (height[k] - height[hull[-1]]) / (2 * (k - hull[-1]))
            if start > starts[-1]:
                break
            hull.pop()
            starts.pop()
        hull.append(k)
        starts.append(start)
    at = np.arange(len(f))
    best = np.array(hull)[np.searchsorted(starts, at, side="right") - 1]
    return f[best] + (at - best) ** 2


def distance_transform(grid: DataFrame, border: bool = False) -> DataFrame:
    """Exact distance from every pixel to the nearest one below 0.5 (or, with border, to outside): row, col, d.

    Two passes of the lower envelope of parabolas, one raster line at a time: columns, then rows."""

    def lines(axis: str, squared: bool):
        other = "row" if axis == "col" else "col"

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(axis)
            n = len(pdf)
            f = pdf["d2"].to_numpy() if squared else np.where(pdf["v"].to_numpy() < 0.5, 0.0, np.inf)
            if border:
                f = np.concatenate([[0.0], f, [0.0]])
            d2 = _envelope(f)
            d2 = d2[1 : n + 1] if border else d2
            return pd.DataFrame({"row": pdf["row"].to_numpy(), "col": pdf["col"].to_numpy(), "d2": d2})

        return other, run

    schema = "row int, col int, d2 double"
    other, run = lines("row", False)
    first = grid.select("row", "col", "v").groupBy(other).applyInPandas(run, schema)
    other, run = lines("col", True)
    return first.groupBy(other).applyInPandas(run, schema).select("row", "col", F.sqrt("d2").alias("d"))


def gray_scott(grid: DataFrame, steps: int, du: float = 0.16, dv: float = 0.08, feed: float = 0.035, kill: float = 0.065, dt: float = 1.0, every: int = 8) -> DataFrame:
    """Reaction and diffusion of (u, v) with clamped edges; the state is written every few steps."""
    state = grid.select("row", "col", "u", "v")
    for step in range(steps):
        around = lambda c: neighbour(c, "col", 1) + neighbour(c, "col", -1) + neighbour(c, "row", 1) + neighbour(c, "row", -1) - 4 * F.col(c)
        uvv = F.col("u") * F.col("v") * F.col("v")
        state = state.withColumns({"_u": F.col("u") + dt * (du * around("u") - uvv + feed * (1 - F.col("u"))), "_v": F.col("v") + dt * (dv * around("v") + uvv - (feed + kill) * F.col("v"))})
        state = state.select("row", "col", F.col("_u").alias("u"), F.col("_v").alias("v"))
        if (step + 1) % every == 0:
            state = saved(state)
    return state


def _lift(x: np.ndarray, kernel: str, back: bool) -> np.ndarray:
    """One level of the lifting transform along the last axis, low half first; mirrored edges."""
    steps = {"5/3": ((1, -0.5), (0, 0.25)), "9/7": ((1, -1.586134342), (0, -0.05298011854), (1, 0.8829110762), (0, 0.4435068522))}[kernel]
    gain = 1.149604398 if kernel == "9/7" else 1.0
    n = x.shape[-1]
    half = (n + 1) // 2
    if n == 1:
        return x.copy()
    y = x.astype(float).copy()
    if back:
        z = np.empty_like(y)
        z[..., 0::2], z[..., 1::2] = y[..., :half] * gain, y[..., half:] / gain
        y = z

    def apply(odd: int, w: float) -> None:
        i = np.arange(odd, n, 2)
        left, right = np.abs(i - 1), i + 1
        right = np.where(right >= n, 2 * (n - 1) - right, right)
        y[..., i] += w * (y[..., left] + y[..., right])

    for odd, w in reversed(steps) if back else steps:
        apply(odd, -w if back else w)
    return y if back else np.concatenate([y[..., 0::2] / gain, y[..., 1::2] * gain], -1)


def dwt_bands(width: int, height: int, levels: int) -> list[tuple[str, int, int, int, int, int]]:
    """(band, level, x, y, width, height) of the packed transform, coarsest first."""
    sizes = [(width, height)]
    for _ in range(levels):
        sizes.append(((sizes[-1][0] + 1) // 2, (sizes[-1][1] + 1) // 2))
    w, h = sizes[-1]
    out = [("LL", levels, 0, 0, w, h)]
    for level in range(levels, 0, -1):
        (pw, ph), (w, h) = sizes[level - 1], sizes[level]
        out += [("HL", level, w, 0, pw - w, h), ("LH", level, 0, h, w, ph - h), ("HH", level, w, h, pw - w, ph - h)]
    return out


def wavelet(grid: DataFrame, levels: int = 3, kernel: str = "5/3", back: bool = False, keys: tuple[str, ...] = ("grid_id",)) -> DataFrame:
    """Forward or inverse lifting transform of every raster, packed in place; one task for each raster."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"])
        w, h = int(pdf["col"].max()) + 1, int(pdf["row"].max()) + 1
        a = pdf["v"].to_numpy().reshape(h, w).copy()
        sizes = [(w, h)]
        for _ in range(levels):
            sizes.append(((sizes[-1][0] + 1) // 2, (sizes[-1][1] + 1) // 2))
        for w1, h1 in sizes[levels - 1 :: -1] if back else sizes[:levels]:
            part = a[:h1, :w1]
            part = _lift(_lift(part.T, kernel, True).T, kernel, True) if back else _lift(_lift(part, kernel, False).T, kernel, False).T
            a[:h1, :w1] = part
        return pdf.assign(v=a.ravel())

    kinds = {f.name: f.dataType.simpleString() for f in grid.schema.fields}
    names = [*keys, "row", "col", "v"]
    return grid.select(*names).groupBy(*keys).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in names))


def threshold_detail(coefficients: DataFrame, width: int, height: int, levels: int, at: float, soft: bool = True) -> DataFrame:
    """Shrinks (or cuts) all coefficients but those of the coarsest band."""
    _, _, _, _, w, h = dwt_bands(width, height, levels)[0]
    v = F.col("v")
    less = F.signum(v) * F.greatest(F.abs(v) - at, F.lit(0.0)) if soft else F.when(F.abs(v) >= at, v).otherwise(0.0)
    return coefficients.withColumn("v", F.when((F.col("col") < w) & (F.col("row") < h), v).otherwise(less))
