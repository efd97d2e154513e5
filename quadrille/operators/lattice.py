"""Lattices: bucket, quadrat, tile and pixel columns, and dense spines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.checkpoints import saved

Box = tuple[float, float, float, float]


def slot(c: Column | str, low: float, size: float, n: int) -> Column:
    """Place of a coordinate among n steps of this size, those outside clamped into the first and last."""
    c = F.col(c) if isinstance(c, str) else c
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((c - low) / size))).cast("int")


def share_slot(c: str, low: float, high: float, n: int) -> Column:
    """Place of a coordinate among n equal parts of [low, high]."""
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((F.col(c) - low) / (high - low) * n))).cast("int")


def spine(df: DataFrame, **sizes: int) -> DataFrame:
    """All combinations of 0..n-1 for each name; bounded by the sizes, not by the data."""
    out = None
    for name, n in sizes.items():
        axis = df.sparkSession.range(n).select(F.col("id").cast("int").alias(name))
        out = axis if out is None else out.crossJoin(axis)
    return out


def bucketed(points: DataFrame, cell: float, box: Box) -> tuple[DataFrame, int, int]:
    """Points with bucket columns bx, by and bucket (row-major); ceil(span / cell) + 1 buckets on each axis."""
    nx, ny = (math.ceil((box[i + 2] - box[i]) / cell) + 1 for i in (0, 1))
    out = points.withColumns({"bx": slot("x", box[0], cell, nx), "by": slot("y", box[1], cell, ny)})
    return out.withColumn("bucket", F.col("by") * nx + F.col("bx")), nx, ny


def bucket_offsets(points: DataFrame, cell: float, box: Box) -> DataFrame:
    """Per bucket, empty ones included: n_points and begin (points in the buckets before)."""
    held, nx, ny = bucketed(points, cell, box)
    counts = spine(points, bucket=nx * ny).join(held.groupBy("bucket").agg(F.count("*").alias("n_points")), "bucket", "left").fillna(0, ["n_points"])
    before = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("begin", F.coalesce(F.sum("n_points").over(before), F.lit(0)))


def lattice_for(points: DataFrame, cell: float) -> DataFrame:
    """One row: the extent of the points and the buckets on each axis."""
    low = points.agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))
    steps = lambda a: (F.ceil((F.col(f"max_{a}") - F.col(f"min_{a}")) / cell) + 1).cast("long")
    return low.withColumns({"nx": steps("x"), "ny": steps("y")})


def quadrats(cells: DataFrame, box: Box, size: float, types: int) -> DataFrame:
    """Counts of every type in every quadrat, empty ones included: type_id, quadrat, n."""
    nx, ny = (math.ceil((box[i + 2] - box[i]) / size) for i in (0, 1))
    held = cells.select("type_id", (slot("y", box[1], size, ny) * nx + slot("x", box[0], size, nx)).alias("quadrat"))
    counts = held.groupBy("type_id", "quadrat").agg(F.count("*").alias("n"))
    return spine(cells, type_id=types, quadrat=nx * ny).join(counts, ["type_id", "quadrat"], "left").fillna(0, ["n"])


def dense_counts(points: DataFrame, box: Box, width: int, height: int, by: str | None = None, values: int = 1) -> DataFrame:
    """Counts of points in width x height pixels, row 0 at the top: [by,] row, col, n."""
    keys = ([by] if by else []) + ["row", "col"]
    held = points.withColumns({"col": share_slot("x", box[0], box[2], width), "row": height - 1 - share_slot("y", box[1], box[3], height)})
    counts = held.groupBy(*keys).agg(F.count("*").alias("n"))
    axes = ({by: values} if by else {}) | {"row": height, "col": width}
    return spine(points, **axes).join(counts, keys, "left").fillna(0, ["n"])


def in_ranges(df: DataFrame, *order: str, parts: int | None = None, name: str = "_part") -> DataFrame:
    """The rows dealt to ranges of ``order``, ascending, with the number of the range; as many as there are shuffle partitions.

    Stored, as a second evaluation may draw other bounds from its sample. Rows of equal order share a range."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(df.repartitionByRange(parts, *order).withColumn(name, F.spark_partition_id()))


def exclusive_scan(df: DataFrame, order: str, value: str, parts: int | None = None) -> DataFrame:
    """Adds scan, the sum of ``value`` over all rows before in ``order``, and total.

    Two passes: rows are range-partitioned, each range is summed, and a range starts from the sums before it, so no
    window runs over the whole table. Rows of equal order share a range and count in the order of their values."""
    ranged = in_ranges(df, order, parts=parts)
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    every = Window.partitionBy(F.lit(0)).orderBy("_part")
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.sum("_sum").over(Window.partitionBy(F.lit(0))).alias("total"))
    before = Window.partitionBy("_part").orderBy(order, value).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(starts), "_part").withColumn("scan", F.col("_start") + F.coalesce(F.sum(value).over(before), F.lit(0))).drop("_part", "_start")
