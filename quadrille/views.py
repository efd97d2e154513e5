"""Canonical views over the driver's tables, and the same views as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators.lattice import dense_counts

#: Window of the cells: minX, minY, maxX, maxY.
BBOX = (1096.0, 0.0, 3500.0, 5000.0)
TYPES = 5
SIDE = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled points: cell_id, x, y, type_id (0..4), region, w (weight)."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("cell_id"),
        F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double").alias("x"),
        (F.col("o_totalprice") / 100).alias("y"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("type_id"),
        F.col("o_orderstatus").alias("region"),
        (F.col("o_totalprice") / 1e5).alias("w"),
    )


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts: x, y, code, qv (quality), fraction (sampled share, may be null)."""
    share = F.when(F.col("l_returnflag") == "A", 0.5).when(F.col("l_returnflag") == "R", 0.25)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("double").alias("x"), F.col("l_suppkey").cast("double").alias("y"), F.col("l_linenumber").cast("int").alias("code"), F.col("l_quantity").alias("qv"), share.alias("fraction")
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small cloud for dense n x n results: the suppliers. id, x, y."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("x"), F.pmod(F.col("s_suppkey") * 37, F.lit(101)).cast("double").alias("y"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature vectors: id, v (array of doubles), label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def grid(spark: SparkSession, sf_dir: str, side: int = SIDE) -> DataFrame:
    """A dense raster: counts of the cells in side x side tiles, row 0 at the top. row, col, v."""
    return dense_counts(cells(spark, sf_dir), BBOX, side, side).select("row", "col", F.col("n").cast("double").alias("v"))


def typed_grid(spark: SparkSession, sf_dir: str, side: int = 32) -> DataFrame:
    """A raster for each type: channel, row, col, v."""
    return dense_counts(cells(spark, sf_dir), BBOX, side, side, by="type_id", values=TYPES).select(F.col("type_id").alias("channel"), "row", "col", F.col("n").cast("double").alias("v"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values over time: key, t (rank of the event), x."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("t"), F.col("value").alias("x"), "event_type")


CELLS = "cells as (select o_orderkey as cell_id, datediff('day', date '1992-01-01', o_orderdate::date)::double as x, o_totalprice / 100 as y, substr(o_orderpriority, 1, 1)::int - 1 as type_id, o_orderstatus as region, o_totalprice / 1e5 as w from orders)"
MOLECULES = "molecules as (select l_partkey::double as x, l_suppkey::double as y, l_linenumber::int as code, l_quantity as qv, case l_returnflag when 'A' then 0.5 when 'R' then 0.25 end::double as fraction from lineitem)"
SITES = "sites as (select s_suppkey as id, s_acctbal / 100 as x, ((s_suppkey * 37) % 101)::double as y from supplier)"
VECTORS = "vectors as (select vec_id as id, embedding::double[] as v, label from embeddings)"
SERIES = "series as (select user_id as key, ts, event_id as t, value as x, event_type from events)"
_TILE = f"least({{n}} - 1, greatest(0, floor(({{c}} - {{low}}) / ({{high}} - {{low}}) * {{n}})))::int"


def grid_sql(side: int = SIDE) -> str:
    x, y = _TILE.format(n=side, c="x", low=BBOX[0], high=BBOX[2]), _TILE.format(n=side, c="y", low=BBOX[1], high=BBOX[3])
    return f"{CELLS}, spots as (select {side} - 1 - {y} as row, {x} as col, count(*) as n from cells group by 1, 2), grid as (select r.i::int as row, c.i::int as col, coalesce(n, 0)::double as v from range({side}) r(i) cross join range({side}) c(i) left join spots on spots.row = r.i and spots.col = c.i)"


def typed_grid_sql(side: int = 32) -> str:
    x, y = _TILE.format(n=side, c="x", low=BBOX[0], high=BBOX[2]), _TILE.format(n=side, c="y", low=BBOX[1], high=BBOX[3])
    return f"{CELLS}, spots as (select type_id, {side} - 1 - {y} as row, {x} as col, count(*) as n from cells group by 1, 2, 3), tgrid as (select t.i::int as channel, r.i::int as row, c.i::int as col, coalesce(n, 0)::double as v from range({TYPES}) t(i) cross join range({side}) r(i) cross join range({side}) c(i) left join spots on spots.type_id = t.i and spots.row = r.i and spots.col = c.i)"
