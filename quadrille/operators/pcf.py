"""Pair correlation: counts of pairs by distance against those of independent points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.geometry import annulus_areas, disk_polygon_area, in_polygon, oriented, ring_area
from quadrille.operators.lattice import Box, spine
from quadrille.operators.range_join import self_pairs, within_radius


def ring_of(r_max: float, bins: int):
    """The ring of a pair by its d2."""
    return F.least(F.lit(bins - 1), F.floor(F.sqrt("d2") / (r_max / bins))).cast("int")


def _rings(r_max: float, bins: int) -> list[float]:
    d = r_max / bins
    return [math.pi * (((k + 1) * d) ** 2 - (k * d) ** 2) for k in range(bins)]


def weighted(points: DataFrame, r_max: float, bins: int, box: Box, edge_corrected: bool, domain: list | None = None) -> DataFrame:
    """Points with inv, one over the area of each ring about them (0 where there is none), within the polygon ``domain`` if there is one."""
    if domain is not None:
        within = [disk_polygon_area(F.col("x"), F.col("y"), F.lit((k + 1) * r_max / bins), domain) for k in range(bins)]
        held = points.withColumn("_a", F.array(*within))
        ring = F.transform("_a", lambda a, k: a - F.when(k > 0, F.get("_a", k - 1)).otherwise(0.0))
        return held.withColumn("inv", F.transform(ring, lambda a: F.when(a > 1e-9, 1.0 / a).otherwise(0.0))).drop("_a")
    if not edge_corrected:
        return points.withColumn("inv", F.array(*[F.lit(1.0 / a) for a in _rings(r_max, bins)]))
    far = F.col("x").between(box[0] + r_max, box[2] - r_max) & F.col("y").between(box[1] + r_max, box[3] - r_max)
    whole = F.array(*[F.lit(1.0 / a) for a in _rings(r_max, bins)])
    areas = annulus_areas(F.col("x"), F.col("y"), r_max, bins, box)
    return points.withColumn("inv", F.when(far, whole).otherwise(F.transform(areas, lambda a: F.when(a > 1e-9, 1.0 / a).otherwise(0.0))))


def cross_pcf(a: DataFrame, b: DataFrame, box: Box, r_max: float, bins: int, edge_corrected: bool = False, domain: list | None = None) -> DataFrame:
    """Per ring: bin, r (middle), n_pairs, g. Two clouds; the same cloud twice counts its self pairs.

    ``domain``: rings of a polygon instead of the box; points outside it are left out, and rings are cut by it."""
    area = (box[2] - box[0]) * (box[3] - box[1])
    if domain is not None:
        area = sum(ring_area(r) for r in oriented(domain))
        a, b = (c.where(in_polygon(F.col("x"), F.col("y"), domain)) for c in (a, b))
    sizes = a.agg(F.count("*").alias("na")).crossJoin(b.agg(F.count("*").alias("nb")))
    pairs = within_radius(weighted(a.select("x", "y"), r_max, bins, box, edge_corrected, domain), b.select("x", "y"), r_max)
    pairs = pairs.withColumn("bin", ring_of(r_max, bins))
    sums = pairs.groupBy("bin").agg(F.count("*").alias("n_pairs"), F.sum(F.get("a_inv", F.col("bin"))).alias("s"))
    full = spine(a, bin=bins).join(sums, "bin", "left").fillna(0, ["n_pairs", "s"]).crossJoin(F.broadcast(sizes))
    rate = F.col("na") * F.col("nb") / area
    return full.select("bin", ((F.col("bin") + 0.5) * (r_max / bins)).alias("r"), "n_pairs", F.when(rate > 0, F.col("s") / rate).otherwise(0.0).alias("g"))


def bin_membership(a: DataFrame, b: DataFrame, r_max: float, bins: int, id_col: str = "cell_id") -> DataFrame:
    """Per point of a with a neighbour in b: bits, a mask of the rings (at most 32) that hold one."""
    if bins > 32:
        raise ValueError("a mask holds 32 rings at most")
    pairs = within_radius(a.select(id_col, "x", "y"), b.select("x", "y"), r_max)
    return pairs.groupBy(F.col(f"a_{id_col}").alias(id_col)).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), ring_of(r_max, bins))).alias("bits"))


def pcf_matrix_binned(cells: DataFrame, box: Box, r_max: float, bins: int, types: int, edge_corrected: bool = False) -> DataFrame:
    """For all ordered pairs of types and rings: n_pairs and g, without self pairs."""
    area = (box[2] - box[0]) * (box[3] - box[1])
    held = weighted(cells.select("cell_id", "type_id", "x", "y"), r_max, bins, box, edge_corrected) if edge_corrected else cells.select("cell_id", "type_id", "x", "y")
    pairs = self_pairs(held, r_max, "cell_id").withColumn("bin", ring_of(r_max, bins))
    inv = (lambda p: F.get(f"{p}_inv", F.col("bin"))) if edge_corrected else (lambda p: F.lit(0.0))
    one = pairs.select(F.col("a_type_id").alias("type_a"), F.col("b_type_id").alias("type_b"), "bin", inv("a").alias("i"), inv("b").alias("j"))
    sums = one.groupBy("type_a", "type_b", "bin").agg(F.count("*").alias("n"), F.sum("i").alias("i"), F.sum("j").alias("j"))
    both = sums.select("type_a", "type_b", "bin", "n", F.col("i").alias("s")).unionAll(sums.select("type_b", "type_a", "bin", "n", "j"))
    both = both.groupBy("type_a", "type_b", "bin").agg(F.sum("n").alias("n_pairs"), F.sum("s").alias("s"))
    counts = F.broadcast(cells.groupBy("type_id").agg(F.count("*").alias("n")))
    full = spine(cells, type_a=types, type_b=types, bin=bins).join(both, ["type_a", "type_b", "bin"], "left").fillna(0, ["n_pairs", "s"])
    full = full.join(counts.toDF("type_a", "na"), "type_a", "left").join(counts.toDF("type_b", "nb"), "type_b", "left").fillna(0, ["na", "nb"])
    rate = F.col("na") * F.col("nb") / area
    ring = F.element_at(F.array(*[F.lit(v) for v in _rings(r_max, bins)]), F.col("bin") + 1)
    total = F.col("s") if edge_corrected else F.col("n_pairs") / ring
    return full.select("type_a", "type_b", "bin", "n_pairs", F.when(rate > 0, total / rate).otherwise(0.0).alias("g"))


def pcf_matrix(cells: DataFrame, box: Box, radius: float) -> DataFrame:
    """For all ordered pairs of the types that occur: n_pairs within the radius and g = n / (nA rhoB pi r^2)."""
    area = (box[2] - box[0]) * (box[3] - box[1])
    pairs = self_pairs(cells.select("cell_id", "type_id", "x", "y"), radius, "cell_id")
    half = pairs.groupBy(F.col("a_type_id").alias("type_a"), F.col("b_type_id").alias("type_b")).agg(F.count("*").alias("n"))
    both = half.unionAll(half.select("type_b", "type_a", "n")).groupBy("type_a", "type_b").agg(F.sum("n").alias("n_pairs"))
    counts = cells.groupBy("type_id").agg(F.count("*").alias("n"))
    full = counts.toDF("type_a", "na").crossJoin(F.broadcast(counts.toDF("type_b", "nb"))).join(both, ["type_a", "type_b"], "left").fillna(0, ["n_pairs"])
    return full.select("type_a", "type_b", "n_pairs", (F.col("n_pairs") * area / (F.col("na") * F.col("nb") * (math.pi * radius * radius))).alias("g"))


def cross_marks(a: DataFrame, b: DataFrame, box: Box, radius: float, id_col: str = "cell_id", kernel=None) -> DataFrame:
    """Per point of a: m, neighbours in b within the radius against their expected number; with a kernel, its sum over b's density."""
    area = (box[2] - box[0]) * (box[3] - box[1])
    density = b.agg((F.count("*") / area).alias("rho"))
    pairs = within_radius(a.select(id_col, "x", "y"), b.select("x", "y"), radius)
    value = F.count("*").cast("double") / (math.pi * radius * radius) if kernel is None else F.sum(kernel(F.col("d2")))
    sums = pairs.groupBy(F.col(f"a_{id_col}").alias(id_col)).agg(value.alias("s"))
    out = a.select(id_col, "x", "y").join(sums, id_col, "left").crossJoin(F.broadcast(density))
    return out.select(id_col, "x", "y", F.when(F.col("rho") > 0, F.coalesce("s", F.lit(0.0)) / F.col("rho")).otherwise(0.0).alias("m"))


def mark_to_m(m, alpha: float):
    """Mark on the scale from -1 to 1: 1 from alpha up, -1 from 1 / alpha down, 0 at 1."""
    return F.when(m >= alpha, 1.0).when(m > 1, (m - 1) / (alpha - 1)).when(m <= 1 / alpha, -1.0).otherwise((1 - F.lit(1.0) / F.greatest(m, F.lit(1e-300))) / (alpha - 1))
