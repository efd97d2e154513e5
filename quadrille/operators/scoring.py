"""Kernels scored on a scene of known association; marks sampled from rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.checkpoints import saved
from quadrille.functions import scales
from quadrille.operators import density, pcf
from quadrille.operators.inference import auc
from quadrille.operators.lattice import Box, share_slot
from quadrille.operators.populations import gauss

KERNELS = (0, 1, 2, 3, "gaussian")


def _marks(scene: DataFrame, box: Box, radius: float, degree: int | str) -> DataFrame:
    a, b = scene.where("type_id = 0"), scene.where("type_id = 1")
    return pcf.cross_marks(a, b, box, radius, kernel=lambda d2: scales.kernel(d2, radius, degree)).select("cell_id", "m")


def kernel_scores(scene: DataFrame, box: Box, base_radius: float, wider: float = 0.02, jitter: float = 0.05, seed: int = 0) -> DataFrame:
    """Per kernel, at the radius of equal second moment: radius, auc (of associated cells by their mark), tied (share of marks
    that others have too), radius_change and jitter_change (relative change of the marks), moment2, roughness.

    ``scene``: cell_id, x, y, type_id, associated. The jitter is one and the same for all kernels."""
    scene = saved(scene)
    size = jitter * base_radius
    moved = saved(scene.withColumns({"x": F.col("x") + size * gauss("cell_id", 1, seed), "y": F.col("y") + size * gauss("cell_id", 2, seed)}))
    truth = scene.where("type_id = 0").select("cell_id", "associated")
    out = None
    for degree in KERNELS:
        r = scales.equivalent_radius(base_radius, degree)
        m = _marks(scene, box, r, degree)
        near = m.join(_marks(scene, box, r * (1 + wider), degree).withColumnRenamed("m", "w"), "cell_id").join(_marks(moved, box, r, degree).withColumnRenamed("m", "j"), "cell_id")
        off = lambda c: F.sqrt(F.sum((F.col(c) - F.col("m")) * (F.col(c) - F.col("m"))) / F.greatest(F.sum(F.col("m") * F.col("m")), F.lit(1e-30)))
        change = near.agg(off("w").alias("radius_change"), off("j").alias("jitter_change"))
        tied = m.groupBy("m").agg(F.count("*").alias("n")).agg((F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("tied"))
        area = auc(m.join(truth, "cell_id"), "m", "associated")
        one = area.crossJoin(tied).crossJoin(change).select(F.lit(str(degree)).alias("kernel"), F.lit(float(r)).alias("radius"), "auc", "tied", "radius_change", "jitter_change", F.lit(float(scales.moment2(r, degree))).alias("moment2"), F.lit(float(scales.roughness(r, degree))).alias("roughness"))
        out = one if out is None else out.unionAll(one)
    return out


def sampled_map(a: DataFrame, b: DataFrame, box: Box, width: int, height: int, radius: float, map_width: int, map_height: int, sigma: float, alpha: float = 5.0) -> DataFrame:
    """A correlation map whose marks are read from a raster of b's disk density at a's pixels, not counted: row, col, v.

    An approximation: its error falls with the pixels; no pairs of points are joined."""
    ras = density.splat_channels(b.select("x", "y", F.lit(0).alias("channel")), box, width, height, radius, 0).select("row", "col", "v")
    rho = b.agg((F.count("*") / ((box[2] - box[0]) * (box[3] - box[1]))).alias("rho"))
    at = a.select("cell_id", "x", "y").withColumns({"col": share_slot("x", box[0], box[2], width), "row": height - 1 - share_slot("y", box[1], box[3], height)})
    marks = at.join(ras, ["row", "col"], "left").crossJoin(F.broadcast(rho)).select("cell_id", "x", "y", pcf.mark_to_m(F.coalesce("v", F.lit(0.0)) / F.col("rho"), alpha).alias("m"))
    return density.correlation_map(marks, box, map_width, map_height, sigma)
