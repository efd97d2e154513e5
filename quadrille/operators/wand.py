"""Places like a given one: whitened distances over co-location modes, patches about a pixel, boundary strength."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.algebra import dot
from quadrille.operators import grids
from quadrille.operators.lattice import spine


def modes(corr: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(values, modes as rows), largest first. Signs agree with the rows of ``before`` where it has as many channels."""
    values, vectors = np.linalg.eigh(corr)
    values, rows = values[::-1], vectors.T[::-1].copy()
    return values, aligned(rows, before)


def aligned(rows: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    """Modes with those turned around whose loadings point away from the same mode of ``before``; the order stays."""
    if before is None or before.shape != rows.shape:
        return rows
    return np.where((rows * before).sum(1, keepdims=True) < 0, -rows, rows)


def whitening(values: np.ndarray, rows: np.ndarray, m: int) -> np.ndarray:
    """The first m modes over the roots of their values; values below a millionth of the largest count as that."""
    floor = max(float(values[0]), 1e-12) * 1e-6
    return rows[:m] / np.sqrt(np.maximum(values[:m], floor))[:, None]


def standardised(rasters: DataFrame) -> DataFrame:
    """Rasters with mean 0 and deviation 1, flat ones 0: channel, row, col, z."""
    m = rasters.groupBy("channel").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    return rasters.join(F.broadcast(m), "channel").select("channel", "row", "col", F.when(F.col("sd") > 0, (F.col("v") - F.col("mean")) / F.col("sd")).otherwise(0.0).alias("z"))


def at_pixel(z: DataFrame, row: int, col: int) -> dict[int, float]:
    """Channels of a pixel; one outside the raster is moved to its edge."""
    ends = z.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    row, col = max(0, min(ends["r"], row)), max(0, min(ends["c"], col))
    return {r["channel"]: r["z"] for r in z.where((F.col("row") == row) & (F.col("col") == col)).collect()}


def similarity(z: DataFrame, white: np.ndarray, ref: dict[int, float]) -> DataFrame:
    """Distance of every pixel to the reference after whitening: row, col, d. The matrix and the reference are part of the plan."""
    k = white.shape[1]
    if len(ref) != k:
        raise ValueError(f"the reference has {len(ref)} channels, the matrix {k}")
    apart = F.array(*[F.sum(F.when(F.col("channel") == c, F.col("z") - ref[c]).otherwise(0.0)) for c in range(k)])
    held = z.groupBy("row", "col").agg(apart.alias("a"))
    along = F.array(*[dot(F.col("a"), F.array(*[F.lit(float(x)) for x in line])) for line in white])
    return held.withColumn("u", along).select("row", "col", F.sqrt(dot(F.col("u"), F.col("u"))).alias("d"))


def patch(channels: DataFrame, row: int, col: int, sigma: float = 0.0, tol: float = 0.0, laplacian: bool = False, rho: float = 0.0) -> DataFrame:
    """The cell about a seed pixel and the patch in it: row, col, patch (boolean).

    The cell is the connected piece, seed included, of the pixels within ``tol`` of the seed's channels (0: any) where the
    distance, smoothed by ``sigma``, curves upwards (``laplacian``). The patch is the piece about the seed that an opening
    by a disc of ``rho`` pixels leaves; below 0.5 it is the cell. Pixels outside the raster are outside the cell."""
    d = grids.mixture_distance(channels, row, col)
    inside = d.select("row", "col", F.lit(True).alias("in"))
    if laplacian:
        smooth = grids.convolve(d, grids.gaussian_kernel(sigma)) if sigma > 0 else d
        inside = grids.laplacian(smooth).select("row", "col", (F.col("v") >= 0).alias("in"))
    if tol > 0:
        near = d.select("row", "col", (F.col("v") <= tol).alias("near"))
        inside = inside.join(near, ["row", "col"]).select("row", "col", (F.col("in") & F.col("near")).alias("in"))
    seed = (F.col("row") == row) & (F.col("col") == col)
    cell = grids.flood(inside.where(F.col("in") | seed).select("row", "col"), row, col)
    if rho < 0.5:
        return cell.withColumn("patch", F.lit(True))
    ends = d.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    raster = lambda mask: spine(d, row=ends["r"] + 1, col=ends["c"] + 1).join(mask.withColumn("m", F.lit(1.0)), ["row", "col"], "left").select("row", "col", F.coalesce("m", F.lit(0.0)).alias("v"))
    kept = grids.distance_transform(raster(cell), border=True).where(F.col("d") >= rho + 1e-4).select("row", "col")
    # distance to what is kept: the transform of its complement
    grown = grids.distance_transform(raster(kept).select("row", "col", (1 - F.col("v")).alias("v"))).where(F.col("d") <= rho).select("row", "col")
    piece = grids.flood(grown, row, col)
    return cell.join(piece.withColumn("p", F.lit(True)), ["row", "col"], "left").select("row", "col", F.coalesce("p", F.lit(False)).alias("patch"))


def boundary(channels: DataFrame, metric: list[list[float]], per_radius: float, main: int | None = None, residual_sigma: float = 0.0) -> DataFrame:
    """How fast the mixed, standardised channels change: row, col, strength (in the steepest direction, per kernel radius of
    ``per_radius`` pixels) and the gradient tensor xx, xy, yy.

    Modes after the first ``main`` are taken from channels blurred by ``residual_sigma`` pixels."""
    m = {r["channel"]: (r["mean"], r["sd"]) for r in channels.groupBy("channel").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")).collect()}
    k = len(metric[0])
    rows = [[w / m[c][1] if m[c][1] > 0 else 0.0 for c, w in enumerate(line)] for line in metric]
    offset = [-sum(w * m[c][0] for c, w in enumerate(line)) for line in rows]
    main = len(rows) if main is None else main
    if residual_sigma > 0 and main < len(rows):
        blurred = grids.convolve(channels, grids.gaussian_kernel(residual_sigma, min(64, max(1, math.ceil(3 * residual_sigma)))), ("channel",))
        rough = grids.channel_mix(channels, [r if i < main else [0.0] * k for i, r in enumerate(rows)], offset)
        soft = grids.channel_mix(blurred, [[0.0] * k if i < main else r for i, r in enumerate(rows)], [0.0] * len(rows))
        mixed = rough.unionByName(soft).groupBy("channel", "row", "col").agg(F.sum("v").alias("v"))
    else:
        mixed = grids.channel_mix(channels, rows, offset)
    t = grids.channel_tensor(mixed).select("row", "col", *[(F.col(c) * per_radius * per_radius).alias(c) for c in ("xx", "xy", "yy")])
    gap = F.col("xx") - F.col("yy")
    most = 0.5 * (F.col("xx") + F.col("yy") + F.sqrt(gap * gap + 4 * F.col("xy") * F.col("xy")))
    return t.select("row", "col", F.sqrt(F.greatest(F.lit(0.0), most)).alias("strength"), "xx", "xy", "yy")
