"""Nearest-neighbour statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.operators.range_join import k_nearest


def nearest_within(points: DataFrame, radius: float, id_col: str = "cell_id") -> DataFrame:
    """Distance to the nearest other point if it lies within the radius, else infinity."""
    near = k_nearest(points, points, 1, radius, id_col, id_col, exclude_self=True).where(F.col("d") <= radius)
    # every point once more, at infinity, instead of a join that might broadcast them
    both = near.select(id_col, "d").unionAll(points.select(id_col, F.lit(float("inf"))))
    return both.groupBy(id_col).agg(F.min("d").alias("d"))


def anni(distances: DataFrame, area: float, d: str = "d") -> DataFrame:
    """Average nearest-neighbour index of distances: mean_distance, expected, anni, z, interpretation (at |z| 1.96)."""
    s = distances.agg(F.avg(d).alias("mean_distance"), F.count("*").cast("double").alias("n"))
    s = s.withColumn("expected", 0.5 / F.sqrt(F.col("n") / area))
    s = s.withColumns({"anni": F.col("mean_distance") / F.col("expected"), "z": (F.col("mean_distance") - F.col("expected")) / (0.26136 / F.sqrt(F.col("n") * F.col("n") / area))})
    said = F.when(F.col("z") < -1.96, "clustered").when(F.col("z") > 1.96, "dispersed").otherwise("random")
    return s.select("mean_distance", "expected", "anni", "z", said.alias("interpretation"))


def polygon_area(vertices: DataFrame) -> DataFrame:
    """Area of a polygon given as (ring, i, x, y); all rings after the first are holes."""
    ring = Window.partitionBy("ring").orderBy("i")
    first = Window.partitionBy("ring").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(first))
    term = vertices.withColumn("t", F.col("x") * following("y") - following("x") * F.col("y"))
    rings = term.groupBy("ring").agg(F.abs(F.sum("t") / 2).alias("a"))
    return rings.agg(F.sum(F.when(F.col("ring") == 0, F.col("a")).otherwise(-F.col("a"))).alias("area"))
