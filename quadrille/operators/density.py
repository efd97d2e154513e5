"""Rasters of points: kernel density, distances, Gram matrices of channels.

Points meet pixels by an equi-join on lattice buckets as wide as the support; sums run per pixel with partial sums before
the shuffle. Rasters have row 0 at the top unless said otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions import scales
from quadrille.functions.geometry import in_box
from quadrille.operators.inference import share
from quadrille.operators.lattice import Box, spine


def pixels(df: DataFrame, box: Box, width: int, height: int) -> DataFrame:
    """All pixels with the world coordinates of their centres: row, col, px, py."""
    px, py = scales.cell_center(F.col("col"), F.col("row"), box, width, height)
    return spine(df, row=height, col=width).withColumns({"px": px, "py": py})


def deposits(points: DataFrame, box: Box, width: int, height: int, reach: float, columns: list[str]) -> DataFrame:
    """Each point with the pixels whose centres may lie within reach: columns, row, col, d2. No join: a point lists its pixels."""
    dx, dy = (box[2] - box[0]) / width, (box[3] - box[1]) / height
    between = lambda low, high, n: (F.greatest(F.lit(0), F.ceil(low)).cast("int"), F.least(F.lit(n - 1), F.floor(high)).cast("int"))
    c0, c1 = between((F.col("x") - reach - box[0]) / dx - 0.5, (F.col("x") + reach - box[0]) / dx - 0.5, width)
    r0, r1 = between((box[3] - F.col("y") - reach) / dy - 0.5, (box[3] - F.col("y") + reach) / dy - 0.5, height)
    held = points.withColumns({"_c0": c0, "_c1": c1, "_r0": r0, "_r1": r1}).where("_c0 <= _c1 and _r0 <= _r1")
    held = held.withColumn("col", F.explode(F.sequence("_c0", "_c1"))).withColumn("row", F.explode(F.sequence("_r0", "_r1")))
    px, py = scales.cell_center(F.col("col"), F.col("row"), box, width, height)
    return held.withColumn("d2", (F.col("x") - px) * (F.col("x") - px) + (F.col("y") - py) * (F.col("y") - py)).select(*columns, "row", "col", "d2")


def _spread(points: DataFrame, box: Box, width: int, height: int, reach: float, value: Column, by: tuple[str, ...] = (), extra: list[str] | None = None) -> DataFrame:
    near = deposits(points, box, width, height, reach, [*by, *(extra or [])])
    return near.where(value != 0).groupBy(*by, "row", "col").agg(F.sum(value).alias("v"))


def _dense(df: DataFrame, sums: DataFrame, width: int, height: int, by: tuple[str, ...] = ()) -> DataFrame:
    frame = spine(df, row=height, col=width)
    if by:
        frame = df.select(*by).distinct().crossJoin(F.broadcast(frame))
    return frame.join(sums, [*by, "row", "col"], "left").fillna(0.0, ["v"])


def kde(points: DataFrame, box: Box, width: int, height: int, sigma: float, cut: float = 4.0, weight: str | None = None) -> DataFrame:
    """Sum of exp(-d2 / 2 sigma^2) at the pixel centres over the points within cut * sigma; not normalised."""
    reach = sigma * cut
    w = F.col(weight) if weight else F.lit(1.0)
    value = F.when(F.col("d2") <= reach * reach, w * F.exp(-F.col("d2") / (2 * sigma * sigma))).otherwise(0.0)
    return _dense(points, _spread(points, box, width, height, reach, value, (), [weight] if weight else []), width, height)


def fixed_point_splat(points: DataFrame, box: Box, width: int, height: int, sigma: float, cut: float = 4.0, scale: int = 1 << 20) -> DataFrame:
    """The same over a square support, summed as whole numbers, so that the order of the points doesn't matter: n (scaled)."""
    value = F.round(F.exp(-F.col("d2") / (2 * sigma * sigma)) * scale).cast("long")
    near = deposits(points, box, width, height, sigma * cut, [])
    sums = near.groupBy("row", "col").agg(F.sum(value).alias("n"))
    return spine(points, row=height, col=width).join(sums, ["row", "col"], "left").fillna(0, ["n"])


def splat_channels(points: DataFrame, box: Box, width: int, height: int, radius: float, degree: int | str, by: str = "channel", weight: str | None = None) -> DataFrame:
    """Unit-mass kernel densities of every channel; points outside the window deposit too: channel, row, col, v."""
    w = F.col(weight) if weight else F.lit(1.0)
    value = w * scales.kernel(F.col("d2"), radius, degree)
    return _dense(points, _spread(points, box, width, height, radius, value, (by,), [weight] if weight else []), width, height, (by,))


def correlation_map(marked: DataFrame, box: Box, width: int, height: int, sigma: float) -> DataFrame:
    """Marks m spread by Gaussians 1 / (sigma sqrt(2 pi)) as far as 3 sigma; row 0 at the BOTTOM: row, col, v."""
    scale = 1 / (sigma * math.sqrt(2 * math.pi))
    value = F.when(F.col("d2") <= 9 * sigma * sigma, F.col("m") * scale * F.exp(-F.col("d2") / (2 * sigma * sigma))).otherwise(0.0)
    top = _dense(marked, _spread(marked, box, width, height, 3 * sigma, value, (), ["m"]), width, height)
    return top.select((height - 1 - F.col("row")).alias("row"), "col", "v")


def gram(rasters: DataFrame, points: DataFrame, box: Box, width: int, height: int, radius: float, degree: int | str, by: str = "channel", id_col: str = "cell_id", weight: str | None = None) -> DataFrame:
    """For all pairs of channels: c (overlap), self_term, g, corr.

    c = sum of products * pixel area; the self term is what shared points give by themselves; g compares the rest with
    independent channels of the same mass in the window; corr is Pearson's over pixels, 1 on the diagonal, 0 if flat."""
    area = (box[2] - box[0]) * (box[3] - box[1])
    pixel = area / (width * height)
    w = F.col(weight) if weight else F.lit(1.0)
    n = float(width * height)
    own = rasters.groupBy(by).agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    slim = rasters.where("v <> 0").select(F.col(by).alias("a"), "row", "col", "v")
    pairs = slim.join(slim.select(F.col("a").alias("b"), "row", "col", F.col("v").alias("u")), ["row", "col"]).groupBy("a", "b").agg(F.sum(F.col("v") * F.col("u")).alias("ab"))
    mass = points.where(in_box(F.col("x"), F.col("y"), box)).groupBy(by).agg(F.sum(w).alias("mass"))
    # a point's kernel against itself, on the points two channels share
    energy = _spread_squared(points, box, width, height, radius, degree, id_col)
    held = points.select(by, id_col, w.alias("_w"))
    common = held.select(F.col(by).alias("a"), id_col, F.col("_w").alias("wa")).join(held.select(F.col(by).alias("b"), id_col, F.col("_w").alias("wb")), id_col).join(energy, id_col)
    selves = common.groupBy("a", "b").agg((F.sum(F.col("wa") * F.col("wb") * F.col("e")) * pixel).alias("self_term"))
    left, right = own.toDF("a", "sa", "ssa").join(mass.toDF("a", "wa"), "a", "left"), own.toDF("b", "sb", "ssb").join(mass.toDF("b", "wb"), "b", "left")
    full = left.crossJoin(F.broadcast(right)).join(pairs, ["a", "b"], "left").join(selves, ["a", "b"], "left").fillna(0.0, ["ab", "self_term", "wa", "wb"])
    c = F.col("ab") * pixel
    va, vb = F.col("ssa") / n - (F.col("sa") / n) ** 2, F.col("ssb") / n - (F.col("sb") / n) ** 2
    sd = F.sqrt(F.greatest(F.lit(0.0), va)) * F.sqrt(F.greatest(F.lit(0.0), vb))
    corr = F.when(sd <= 0, 0.0).when(F.col("a") == F.col("b"), 1.0).otherwise((F.col("ab") / n - F.col("sa") * F.col("sb") / (n * n)) / F.when(sd > 0, sd).otherwise(1.0))
    return full.select("a", "b", c.alias("c"), "self_term", share(c - F.col("self_term"), F.col("wa") * F.col("wb") / area).alias("g"), corr.alias("corr"))


def _spread_squared(points: DataFrame, box: Box, width: int, height: int, radius: float, degree: int | str, id_col: str) -> DataFrame:
    one = points.select(id_col, "x", "y").dropDuplicates([id_col])
    near = deposits(one, box, width, height, radius, [id_col])
    k = scales.kernel(F.col("d2"), radius, degree)
    return near.groupBy(id_col).agg(F.sum(k * k).alias("e"))


def null_mean_gram(points: DataFrame, box: Box, width: int, height: int, radius: float, degree: int | str, by: str = "channel") -> DataFrame:
    """Mean overlap of channels when their labels are dealt at random over all points: a, b, expected.

    With R the integral of the squared kernel and P the overlap of all points without their self terms, it is
    R n_a [a = b] + P (n_a n_b - n_a [a = b]) / (n (n - 1)): one raster of all points, however many labellings."""
    pixel = (box[2] - box[0]) * (box[3] - box[1]) / (width * height)
    r = scales.roughness(radius, degree)
    every = splat_channels(points.select("x", "y", F.lit(0).alias("channel")), box, width, height, radius, degree)
    total = every.agg((F.sum(F.col("v") * F.col("v")) * pixel).alias("c")).crossJoin(points.agg(F.count("*").cast("double").alias("n")))
    own = points.groupBy(by).agg(F.count("*").cast("double").alias("m"))
    both = own.toDF("a", "ma").crossJoin(F.broadcast(own.toDF("b", "mb"))).crossJoin(F.broadcast(total))
    same = F.when(F.col("a") == F.col("b"), F.col("ma")).otherwise(0.0)
    spread = (F.col("c") - F.col("n") * r) * (F.col("ma") * F.col("mb") - same) / (F.col("n") * (F.col("n") - 1))
    return both.select("a", "b", F.when(F.col("n") < 2, 0.0).otherwise(same * r + spread).alias("expected"))


def apron_coverage(points: DataFrame, box: Box, radius: float, by: str = "channel") -> DataFrame:
    """Per channel: mass in the window, mass in the ring about it as wide as the radius, and the ratio of their densities."""
    area = (box[2] - box[0]) * (box[3] - box[1])
    wide = (box[0] - radius, box[1] - radius, box[2] + radius, box[3] + radius)
    ring = (wide[2] - wide[0]) * (wide[3] - wide[1]) - area
    inside, about = in_box(F.col("x"), F.col("y"), box), in_box(F.col("x"), F.col("y"), wide)
    sums = points.groupBy(by).agg(F.count_if(inside).cast("double").alias("mass"), F.count_if(about & ~inside).cast("double").alias("apron"))
    return sums.select(by, "mass", "apron", F.when(F.col("mass") > 0, (F.col("apron") / ring) / (F.col("mass") / area)).otherwise(0.0).alias("coverage"))


def channel_bins(molecules: DataFrame, weights: dict[int, tuple[str, float]], size: float, box: Box, least: float | None = None) -> DataFrame:
    """Molecules of the wanted codes in bins: bin, channel, count (weight over the sampled share), sampled (reads)."""
    table = F.create_map(*[F.lit(v) for c, (name, w) in weights.items() for v in (c, F.struct(F.lit(name).alias("channel"), F.lit(float(w)).alias("weight")))])
    nx = math.ceil((box[2] - box[0]) / size)
    held = molecules.where(F.col("code").isin(list(weights)) & in_box(F.col("x"), F.col("y"), box))
    held = held.where(F.col("qv") >= least) if least is not None else held
    entry = F.element_at(table, F.col("code"))
    spot = F.floor((F.col("y") - box[1]) / size) * nx + F.least(F.lit(nx - 1), F.floor((F.col("x") - box[0]) / size))
    return held.groupBy(spot.cast("long").alias("bin"), entry["channel"].alias("channel")).agg(F.sum(entry["weight"] / F.coalesce("fraction", F.lit(1.0))).alias("count"), F.count("*").alias("sampled"))


def pooled_bins(bins: DataFrame, nx: int, radius: int = 1) -> DataFrame:
    """Sums over the (2 radius + 1)^2 bins around every occupied bin: bin, channel, count."""
    at = bins.select((F.col("bin") % nx).cast("int").alias("bx"), F.floor(F.col("bin") / nx).cast("int").alias("by"), "channel", "count")
    moves = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)])
    sent = at.withColumn("m", F.explode(moves)).select((F.col("bx") + F.col("m.i")).alias("bx"), (F.col("by") + F.col("m.j")).alias("by"), "channel", "count")
    sums = sent.where(F.col("bx").between(0, nx - 1)).groupBy("bx", "by", "channel").agg(F.sum("count").alias("count"))
    own = at.select("bx", "by").distinct()
    return sums.join(own, ["bx", "by"], "left_semi").select((F.col("by") * nx + F.col("bx")).cast("long").alias("bin"), "channel", "count")


def bin_composition(bins: DataFrame, least: float) -> DataFrame:
    """Root shares of the channels of every bin; weight: the bin's total if it has enough reads, else 0."""
    w = Window.partitionBy("bin")
    total = F.sum("count").over(w)
    return bins.select("bin", "channel", F.sqrt(share(F.col("count"), total)).alias("root"), F.when(F.sum("sampled").over(w) >= least, total).otherwise(0.0).alias("weight"))


def transcript_channels(molecules: DataFrame, weights: dict[int, tuple[str, float]], window: Box, apron: float, least: float) -> tuple[DataFrame, DataFrame]:
    """(x, y, channel, w) of molecules in the widened window, and one row of why the others went, in that order:
    considered, out_of_reach, below_minimum, unselected. Raises ValueError if a weight is not positive."""
    if any(w <= 0 for _, w in weights.values()):
        raise ValueError("weights must be positive")
    wide = (window[0] - apron, window[1] - apron, window[2] + apron, window[3] + apron)
    near, good, wanted = in_box(F.col("x"), F.col("y"), wide), F.coalesce(F.col("qv") >= least, F.lit(False)), F.col("code").isin(list(weights))
    stats = molecules.agg(F.count("*").alias("considered"), F.count_if(~near).alias("out_of_reach"), F.count_if(near & ~good).alias("below_minimum"), F.count_if(near & good & ~wanted).alias("unselected"))
    table = F.create_map(*[F.lit(v) for c, (name, w) in weights.items() for v in (c, F.struct(F.lit(name).alias("channel"), F.lit(float(w)).alias("weight")))])
    entry = F.element_at(table, F.col("code"))
    return molecules.where(near & good & wanted).select("x", "y", entry["channel"].alias("channel"), (entry["weight"] / F.coalesce("fraction", F.lit(1.0))).alias("w")), stats


def tiles(points: DataFrame, box: Box, nx: int, ny: int) -> DataFrame:
    """Points with their tile: half-open, the last one closed; those outside are dropped."""
    spot = lambda c, low, high, n: F.when(F.col(c) == high, n - 1).otherwise(F.floor((F.col(c) - low) / (high - low) * n)).cast("int")
    return points.where(in_box(F.col("x"), F.col("y"), box)).withColumns({"tile_x": spot("x", box[0], box[2], nx), "tile_y": spot("y", box[1], box[3], ny)})
