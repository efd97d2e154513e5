"""Queries on rasters: stencils, morphology, calculus, regions, densities, Gram matrices."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from quadrille import views as v
from quadrille.functions.geometry import disk_rect_area, disk_rect_sql
from quadrille.operators import density, grids, lattice, pcf, wand
from quadrille.operators.range_join import k_nearest
from quadrille.plans.registry import query

X0, Y0, X1, Y1 = v.BBOX
G = f"with {v.grid_sql()}"
TG = f"with {v.typed_grid_sql()}"
N = v.SIDE


def _stencil_sql(weights: list[float], source: str = "grid", n: int = N) -> str:
    r = len(weights) // 2
    values = ", ".join(f"({k}, {w!r}::double)" for k, w in zip(range(-r, r + 1), weights, strict=True))
    return (
        f"kw as (select * from (values {values}) kw(k, w)), hx as (select o.row, o.col, sum(s.v * w) as v from {source} o cross join kw join {source} s on s.row = o.row and s.col = least({n - 1}, greatest(0, o.col + k)) group by 1, 2), "
        f"conv as (select o.row, o.col, sum(s.v * w) as v from hx o cross join kw join hx s on s.col = o.col and s.row = least({n - 1}, greatest(0, o.row + k)) group by 1, 2)"
    )


@query("convolve_box", f"{G}, {_stencil_sql([1.0] * 5)} select row, col, v from conv", "v")
def convolve_box(spark, sf):
    """Box sums."""
    return grids.convolve(v.grid(spark, sf), grids.box_kernel(2))


@query("convolve_gaussian", f"{G}, {_stencil_sql(grids.gaussian_kernel(1.5))} select row, col, v from conv", "v")
def convolve_gaussian(spark, sf):
    """Gaussian smoothing."""
    return grids.convolve(v.grid(spark, sf), grids.gaussian_kernel(1.5))


@query("gaussian_kernel", "with w as (select i::int as k, exp(-(i * i) / (2 * 1.5 * 1.5)) as e from range(-5, 6) r(i)) select k, e / sum(e) over () as w from w", "w", 9)
def gaussian_kernel(spark, sf):
    """Normalised weights."""
    return spark.createDataFrame(list(zip(range(-5, 6), grids.gaussian_kernel(1.5), strict=True)), "k int, w double")


def _extreme_sql(pick: str, source: str, name: str, r: int) -> str:
    return f"{name} as (select o.row, o.col, {pick}(s.v) as v from {source} o join {source} s on s.row between o.row - {r} and o.row + {r} and s.col between o.col - {r} and o.col + {r} group by 1, 2)"


@query("morph_erode", f"{G}, {_extreme_sql('min', 'grid', 'e', 1)} select * from e")
def morph_erode(spark, sf):
    return grids.erode(v.grid(spark, sf), 1)


@query("morph_dilate", f"{G}, {_extreme_sql('max', 'grid', 'e', 1)} select * from e")
def morph_dilate(spark, sf):
    return grids.dilate(v.grid(spark, sf), 1)


@query("morph_open", f"{G}, {_extreme_sql('min', 'grid', 'e', 1)}, {_extreme_sql('max', 'e', 'd', 1)} select * from d")
def morph_open(spark, sf):
    return grids.opened(v.grid(spark, sf), 1)


@query("morph_close", f"{G}, {_extreme_sql('max', 'grid', 'e', 1)}, {_extreme_sql('min', 'e', 'd', 1)} select * from d")
def morph_close(spark, sf):
    return grids.closed(v.grid(spark, sf), 1)


for _mode, _agg in (("mean", "avg"), ("min", "min"), ("max", "max")):

    @query(f"decimate_{_mode}", f"{G} select (row // 5)::int as row, (col // 5)::int as col, {_agg}(v) as v from grid group by 1, 2", "v")
    def _decimate(spark, sf, mode=_mode):
        """Blocks of five pixels reduced."""
        return grids.decimate(v.grid(spark, sf), 5, mode)


@query("add_grids", f"{G}, {_stencil_sql([1.0] * 3)} select row, col, grid.v * 0.5 + conv.v * 2 as v from grid join conv using (row, col)", "v")
def add_grids(spark, sf):
    """A weighted sum of two rasters."""
    a, b = v.grid(spark, sf), grids.convolve(v.grid(spark, sf), grids.box_kernel(1)).withColumnRenamed("v", "u")
    return a.join(b, ["row", "col"]).select("row", "col", (F.col("v") * 0.5 + F.col("u") * 2).alias("v"))


def _near(name: str = "grid", c: str = "v", n: int = N) -> str:
    at = lambda a, dr, dc: f"join {name} {a} on {a}.row = least({n - 1}, greatest(0, o.row + {dr})) and {a}.col = least({n - 1}, greatest(0, o.col + {dc}))"
    return f"{name} o {at('e', 0, 1)} {at('w', 0, -1)} {at('s', 1, 0)} {at('n', -1, 0)}"


@query("gradient", f"{G} select o.row, o.col, (e.v - w.v) * 0.5 as gx, (s.v - n.v) * 0.5 as gy from {_near()}")
def gradient(spark, sf):
    return grids.gradient(v.grid(spark, sf))


@query("gradient_magnitude", f"{G} select o.row, o.col, sqrt(pow((e.v - w.v) * 0.5, 2) + pow((s.v - n.v) * 0.5, 2)) as v from {_near()}", "v")
def gradient_magnitude(spark, sf):
    return grids.gradient(v.grid(spark, sf)).select("row", "col", F.hypot("gx", "gy").alias("v"))


@query("laplacian", f"{G} select o.row, o.col, e.v + w.v + s.v + n.v - 4 * o.v as v from {_near()}")
def laplacian(spark, sf):
    return grids.laplacian(v.grid(spark, sf))


@query("divergence", f"{G}, f as (select o.row, o.col, (e.v - w.v) * 0.5 as gx, (s.v - n.v) * 0.5 as gy from {_near()}) select o.row, o.col, (e.gx - w.gx) * 0.5 + (s.gy - n.gy) * 0.5 as v from {_near('f')}")
def divergence(spark, sf):
    return grids.divergence(grids.gradient(v.grid(spark, sf)))


@query(
    "structure_orientation",
    f"""{G}, f as (select o.row, o.col, (e.v - w.v) * 0.5 as gx, (s.v - n.v) * 0.5 as gy from {_near()}),
    k as (select unnest(range(-2, 3)) as i),
    t as (select o.row, o.col, avg(s.gx * s.gx) as xx, avg(s.gx * s.gy) as xy, avg(s.gy * s.gy) as yy from f o cross join k a cross join k b join f s on s.row = least({N - 1}, greatest(0, o.row + a.i)) and s.col = least({N - 1}, greatest(0, o.col + b.i)) group by 1, 2),
    u as (select *, 0.5 * atan2(2 * xy, xx - yy) as th, case when xx + yy > 1e-12 then sqrt((xx - yy) * (xx - yy) + 4 * xy * xy) / (xx + yy) else 0 end as co from t)
    select row, col, cos(th) * co as ox, sin(th) * co as oy from u""",
    "ox oy", 5,
)
def structure_orientation(spark, sf):
    """Orientation and coherence of a raster."""
    return grids.structure_orientation(v.grid(spark, sf), 2)


@query(
    "channel_structure_tensor",
    f"""{TG}, g as (select o.channel, o.row, o.col, (coalesce(e.v, o.v) - coalesce(w.v, o.v)) / ((e.v is not null)::int + (w.v is not null)::int) as gx, (coalesce(s.v, o.v) - coalesce(n.v, o.v)) / ((s.v is not null)::int + (n.v is not null)::int) as gy
    from tgrid o left join tgrid e on e.channel = o.channel and e.row = o.row and e.col = o.col + 1 left join tgrid w on w.channel = o.channel and w.row = o.row and w.col = o.col - 1 left join tgrid s on s.channel = o.channel and s.row = o.row + 1 and s.col = o.col left join tgrid n on n.channel = o.channel and n.row = o.row - 1 and n.col = o.col)
    select row, col, sum(gx * gx) as xx, sum(gx * gy) as xy, sum(gy * gy) as yy from g group by 1, 2""",
    "xx xy yy",
)
def channel_structure_tensor(spark, sf):
    """Gradient tensor over channels."""
    return grids.channel_tensor(v.typed_grid(spark, sf))


_MIX = [[0.5, 0.25, 0.0, 0.0, 1.0], [0.0, 1.0, -1.0, 0.5, 0.0]]


@query("channel_mix", f"{TG} select 0::int as channel, row, col, sum(v * [0.5, 0.25, 0.0, 0.0, 1.0][channel + 1]) + 1 as v from tgrid group by row, col union all select 1, row, col, sum(v * [0.0, 1.0, -1.0, 0.5, 0.0][channel + 1]) - 2 from tgrid group by row, col", "v")
def channel_mix(spark, sf):
    """A linear mix of channels."""
    return grids.channel_mix(v.typed_grid(spark, sf), _MIX, [1.0, -2.0])


@query("mixture_distance", f"{TG} select t.row, t.col, sqrt(sum((t.v - s.v) * (t.v - s.v))) as v from tgrid t join tgrid s on s.channel = t.channel and s.row = 7 and s.col = 9 group by 1, 2", "v")
def mixture_distance(spark, sf):
    """Distance of pixels to a seed over all channels."""
    return grids.mixture_distance(v.typed_grid(spark, sf), 7, 9)


_GI = f"{_stencil_sql([1.0] * 5)}, m as (select avg(v) as mean, stddev_pop(v) as sd, count(*)::double as n from {{0}}) select row, col, case when sd > 0 then (v - mean * 25) / (sd * sqrt(25 * (n - 25) / (n - 1))) else 0 end as z, mean, sd from conv cross join m"


@query("getis_ord", f"{G}, {_GI.format('grid')}", "z mean sd")
def getis_ord(spark, sf):
    """Hot spots of a raster."""
    return grids.getis_ord(v.grid(spark, sf), 2)


@query("field_max", f"{G} select max(v) as m from grid")
def field_max(spark, sf):
    return v.grid(spark, sf).agg(F.max("v").alias("m"))


_MASKED = f"mask as (select row, col from grid where v > (select median(v) from grid)), seed as (select row, col from mask order by abs(row - 32) + abs(col - 32), row, col limit 1)"


def _mask(spark, sf):
    g = v.grid(spark, sf)
    return g.crossJoin(F.broadcast(g.agg(F.median("v").alias("m")))).where("v > m").select("row", "col")


@query("flood_from", f"with recursive {v.grid_sql()}, {_MASKED}, r as (select row, col from seed union select m.row, m.col from r join mask m on abs(m.row - r.row) + abs(m.col - r.col) = 1) select row, col from r")
def flood_from(spark, sf):
    """The piece of a mask that holds the seed."""
    m = _mask(spark, sf)
    seed = m.orderBy(F.abs(F.col("row") - 32) + F.abs(F.col("col") - 32), "row", "col").first()
    return grids.flood(m, seed["row"], seed["col"])


@query("connected_region", f"with recursive {v.typed_grid_sql()}, d as (select t.row, t.col, sqrt(sum((t.v - s.v) * (t.v - s.v))) as v from tgrid t join tgrid s on s.channel = t.channel and s.row = 7 and s.col = 9 group by 1, 2), k as (select row, col from d where v <= (select median(v) from d)), r as (select 7 as row, 9 as col union select k.row, k.col from r join k on abs(k.row - r.row) + abs(k.col - r.col) = 1) select row, col from r")
def connected_region(spark, sf):
    """The piece about the seed within a distance."""
    d = mixture_distance(spark, sf)
    m = d.crossJoin(F.broadcast(d.agg(F.median("v").alias("m")))).where("v <= m").select("row", "col")
    return grids.flood(m, 7, 9)


@query("distance_transform", f"{G}, b as (select row, col from grid where v < 0.5) select g.row, g.col, case when (select count(*) from b) = 0 then 'infinity'::double else (select sqrt(min((g.row - b.row) * (g.row - b.row) + (g.col - b.col) * (g.col - b.col))) from b) end as d from grid g", "d")
def distance_transform(spark, sf):
    """Distance of pixels to the nearest empty one."""
    return grids.distance_transform(v.grid(spark, sf))


_PIX = f"pix as (select row, col, {X0} + (col + 0.5) * {(X1 - X0) / N} as px, {Y1} - (row + 0.5) * {(Y1 - Y0) / N} as py from grid)"
_D2 = "(x - px) * (x - px) + (y - py) * (y - py)"


def _kde_sql(weight: str = "1", sigma: float = 60.0, cut: float = 3.0) -> str:
    reach = sigma * cut
    return f"k as (select row, col, sum({weight} * exp(-({_D2}) / {2 * sigma * sigma})) as s from pix join cells on x between px - {reach} and px + {reach} and {_D2} <= {reach * reach} group by 1, 2), kde as (select pix.row, pix.col, coalesce(s, 0)::double as v from pix left join k using (row, col))"


@query("kde_field", f"{G}, {_PIX}, {_kde_sql()} select row, col, v from kde", "v")
def kde_field(spark, sf):
    """Gaussian kernel density, not normalised."""
    return density.kde(v.cells(spark, sf), v.BBOX, N, N, 60.0, 3.0)


@query("splat_density", f"{G}, {_PIX}, {_kde_sql('w')} select row, col, v from kde", "v")
def splat_density(spark, sf):
    """The same of weighted points."""
    return density.kde(v.cells(spark, sf), v.BBOX, N, N, 60.0, 3.0, "w")


@query("masked_density", f"{G}, {_PIX}, {_kde_sql('(x between 1500 and 2500)::int')} select row, col, v from kde", "v")
def masked_density(spark, sf):
    """The same of points under a mask."""
    return density.kde(v.cells(spark, sf).where(F.col("x").between(1500, 2500)), v.BBOX, N, N, 60.0, 3.0)


@query("splat_fixed_point", f"{G}, {_PIX}, k as (select row, col, sum(round(exp(-({_D2}) / 7200) * 1048576)::bigint)::bigint as n from pix join cells on x between px - 180 and px + 180 and y between py - 180 and py + 180 group by 1, 2) select pix.row, pix.col, coalesce(n, 0)::bigint as n from pix left join k using (row, col)")
def splat_fixed_point(spark, sf):
    """Whole-number sums over a square support."""
    return density.fixed_point_splat(v.cells(spark, sf), v.BBOX, N, N, 60.0, 3.0)


@query("point_hotspots", f"{G}, {_PIX}, {_kde_sql()}, {_stencil_sql([1.0] * 5, 'kde')}, m as (select avg(v) as mean, stddev_pop(v) as sd, count(*)::double as n from kde) select row, col, case when sd > 0 then (v - mean * 25) / (sd * sqrt(25 * (n - 25) / (n - 1))) else 0 end as z from conv cross join m", "z")
def point_hotspots(spark, sf):
    """Hot spots of points."""
    return grids.getis_ord(kde_field(spark, sf), 2).select("row", "col", "z")


@query("distance_field", f"{G}, {_PIX} select row, col, sqrt(min({_D2})) as d from pix cross join cells group by 1, 2", "d")
def distance_field(spark, sf):
    """Distance of pixels to the nearest cell."""
    return _nearest(spark, sf, 1).select("row", "col", "d")


def _nearest(spark, sf, k):
    p = density.pixels(v.cells(spark, sf), v.BBOX, N, N).select((F.col("row") * N + F.col("col")).cast("long").alias("pixel"), F.col("px").alias("x"), F.col("py").alias("y"))
    near = k_nearest(p, v.cells(spark, sf), k, 40.0, "pixel", "cell_id")
    return near.select(F.floor(F.col("pixel") / N).cast("int").alias("row"), (F.col("pixel") % N).cast("int").alias("col"), "d")


@query("dtm_field", f"{G}, {_PIX}, m as (select row, col, min({_D2}, 5) as ds from pix cross join cells group by 1, 2) select row, col, sqrt(list_avg(ds)) as d from m", "d")
def dtm_field(spark, sf):
    """Root mean square of the five nearest distances."""
    return _nearest(spark, sf, 5).groupBy("row", "col").agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("d"))


_R2 = 150.0
_K2 = f"3 / {math.pi * _R2 * _R2!r}::double * pow(1 - ({_D2}) / {_R2 * _R2}, 2)"
_TPIX = f"pix as (select distinct row, col, {X0} + (col + 0.5) * {(X1 - X0) / 32} as px, {Y1} - (row + 0.5) * {(Y1 - Y0) / 32} as py from tgrid)"
_SPLAT = f"{_TPIX}, dep as (select type_id as channel, row, col, sum({_K2}) as s from pix join cells on x between px - {_R2} and px + {_R2} and {_D2} < {_R2 * _R2} group by 1, 2, 3), ras as (select t.channel, t.row, t.col, coalesce(s, 0)::double as v from tgrid t left join dep using (channel, row, col))"


def _channels(spark, sf):
    return v.cells(spark, sf).withColumnRenamed("type_id", "channel")


@query("splat_channel", f"{TG}, {_SPLAT} select channel, row, col, v * 1e6 as v from ras", "v")
def splat_channel(spark, sf):
    """Unit-mass densities of every type, in cells per million square units."""
    return density.splat_channels(_channels(spark, sf), v.BBOX, 32, 32, _R2, 2).withColumn("v", F.col("v") * 1e6)


_PIXEL = (X1 - X0) * (Y1 - Y0) / 1024
_AREA = (X1 - X0) * (Y1 - Y0)
_GRAM = f"""{TG}, {_SPLAT}, pr as (select a.channel as a, b.channel as b, sum(a.v * b.v) as ab, corr(a.v, b.v) as r from ras a join ras b using (row, col) group by 1, 2),
    mass as (select type_id as channel, count(*)::double as mass from cells where x between {X0} and {X1} and y between {Y0} and {Y1} group by 1),
    slf as (select type_id as channel, sum(pow({_K2}, 2)) * {_PIXEL!r} as s from pix join cells on x between px - {_R2} and px + {_R2} and {_D2} < {_R2 * _R2} group by 1)"""


def _gram(spark, sf):
    ras = density.splat_channels(_channels(spark, sf), v.BBOX, 32, 32, _R2, 2)
    return density.gram(ras, _channels(spark, sf), v.BBOX, 32, 32, _R2, 2)


@query("gram_matrix", f"{_GRAM} select a, b, ab * {_PIXEL!r} * 1e3 as c from pr", "c", 5)
def gram_matrix(spark, sf):
    """Overlap of all pairs of channels, in thousandths."""
    return _gram(spark, sf).select("a", "b", (F.col("c") * 1e3).alias("c"))


@query("gram_corr", f"{_GRAM} select a, b, case when a = b then 1.0 else r end::double as corr from pr", "corr")
def gram_corr(spark, sf):
    """Correlation of all pairs of channels."""
    return _gram(spark, sf).select("a", "b", "corr")


@query("gram_g", f"{_GRAM} select a, b, (ab * {_PIXEL!r} - case when a = b then s else 0 end) / (ma.mass * mb.mass / {_AREA!r}) as g from pr join mass ma on ma.channel = a join mass mb on mb.channel = b join slf on slf.channel = a", "g")
def gram_g(spark, sf):
    """Overlap against that of independent channels."""
    return _gram(spark, sf).select("a", "b", "g")


_R2N = 9 / (5 * math.pi * _R2 * _R2)


@query("null_mean_gram", f"{TG}, {_SPLAT}, al as (select row, col, sum(v) as v from ras group by 1, 2), t as (select sum(v * v) * {_PIXEL!r} as c, (select count(*) from cells)::double as n from al), k as (select type_id, count(*)::double as m from cells group by 1) select x.type_id as a, y.type_id as b, 1e3 * (case when x.type_id = y.type_id then x.m * {_R2N!r} else 0 end + (c - n * {_R2N!r}) * (x.m * y.m - case when x.type_id = y.type_id then x.m else 0 end) / (n * (n - 1))) as expected from k x cross join k y cross join t", "expected", 5)
def null_mean_gram(spark, sf):
    """Mean overlap of channels under random labels, in thousandths."""
    got = density.null_mean_gram(_channels(spark, sf), v.BBOX, 32, 32, _R2, 2)
    return got.select("a", "b", (F.col("expected") * 1e3).alias("expected"))


@query("colocation_modes")
def colocation_modes(spark, sf):
    """Modes of the channel correlations: mode, explained, and the loading of each channel."""
    got = gram_corr(spark, sf).toPandas().pivot(index="a", columns="b", values="corr").to_numpy()
    values, vectors = np.linalg.eigh(got)
    order = values.argsort()[::-1]
    rows = [(k, float(values[i] / values.sum()), int(c), float(vectors[c, i])) for k, i in enumerate(order) for c in range(len(values))]
    return spark.createDataFrame(rows, "mode int, explained double, channel int, loading double")


@query("project_mode")
def project_mode(spark, sf):
    """Raster of the first mode."""
    ras = density.splat_channels(_channels(spark, sf), v.BBOX, 32, 32, _R2, 2)
    loading = colocation_modes(spark, sf).where("mode = 0").select("channel", "loading")
    m = ras.groupBy("channel").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    z = ras.join(F.broadcast(m), "channel").join(F.broadcast(loading), "channel").withColumn("z", F.when(F.col("sd") > 0, (F.col("v") - F.col("mean")) / F.col("sd")).otherwise(0.0))
    return z.groupBy("row", "col").agg(F.sum(F.col("z") * F.col("loading")).alias("v"))


@query("similarity_field")
def similarity_field(spark, sf):
    """Whitened distance of every pixel to the middle one, over three modes."""
    ras = density.splat_channels(_channels(spark, sf), v.BBOX, 32, 32, _R2, 2)
    got = gram_corr(spark, sf).toPandas().pivot(index="a", columns="b", values="corr").to_numpy()
    values, rows = wand.modes(got)
    z = wand.standardised(ras)
    return wand.similarity(z, wand.whitening(values, rows, 3), wand.at_pixel(z, 16, 16))


@query("wand_patch", f"with recursive {v.typed_grid_sql()}, d as (select t.row, t.col, sqrt(sum((t.v - s.v) * (t.v - s.v))) as v from tgrid t join tgrid s on s.channel = t.channel and s.row = 7 and s.col = 9 group by 1, 2), k as (select row, col from d where v <= 4 or (row = 7 and col = 9)), r as (select 7 as row, 9 as col union select k.row, k.col from r join k on abs(k.row - r.row) + abs(k.col - r.col) = 1), frame as (select r.i::int as row, c.i::int as col from range(-1, 33) r(i) cross join range(-1, 33) c(i)), rim as (select f.row, f.col from frame f left join r on r.row = f.row and r.col = f.col where r.row is null), er as (select r.row, r.col from r where not exists (select 1 from rim where (rim.row - r.row) * (rim.row - r.row) + (rim.col - r.col) * (rim.col - r.col) <= 1)), op as (select f.row, f.col from frame f where exists (select 1 from er where (er.row - f.row) * (er.row - f.row) + (er.col - f.col) * (er.col - f.col) <= 1)), p as (select 7 as row, 9 as col from op where row = 7 and col = 9 union select op.row, op.col from p join op on abs(op.row - p.row) + abs(op.col - p.col) = 1) select r.row, r.col, p.row is not null as patch from r left join p on p.row = r.row and p.col = r.col")
def wand_patch(spark, sf):
    """The piece about a pixel whose channels are like its own, and what an opening leaves of it."""
    return wand.patch(v.typed_grid(spark, sf), 7, 9, tol=4.0, rho=1.0)


@query("wand_field", f"{TG}, m as (select channel, avg(v) as mean, stddev_pop(v) as sd from tgrid group by 1), u as (select 0::int as channel, row, col, sum(case when channel < 2 then (v - mean) / sd else 0 end) as v from tgrid join m using (channel) group by row, col union all select 1, row, col, sum(case channel when 2 then 0.5 when 3 then -1.0 else 0 end * (v - mean) / sd) from tgrid join m using (channel) group by row, col), g as (select o.channel, o.row, o.col, (coalesce(e.v, o.v) - coalesce(w.v, o.v)) / ((e.v is not null)::int + (w.v is not null)::int) as gx, (coalesce(s.v, o.v) - coalesce(n.v, o.v)) / ((s.v is not null)::int + (n.v is not null)::int) as gy from u o left join u e on e.channel = o.channel and e.row = o.row and e.col = o.col + 1 left join u w on w.channel = o.channel and w.row = o.row and w.col = o.col - 1 left join u s on s.channel = o.channel and s.row = o.row + 1 and s.col = o.col left join u n on n.channel = o.channel and n.row = o.row - 1 and n.col = o.col), t as (select row, col, 4 * sum(gx * gx) as xx, 4 * sum(gx * gy) as xy, 4 * sum(gy * gy) as yy from g group by 1, 2) select row, col, sqrt(greatest(0, 0.5 * (xx + yy + sqrt((xx - yy) * (xx - yy) + 4 * xy * xy)))) as strength, xx, xy, yy from t", "strength xx xy yy")
def wand_field(spark, sf):
    """Boundary strength of mixed, standardised channels per kernel radius."""
    a = [[1.0, 1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.5, -1.0, 0.0]]
    return wand.boundary(v.typed_grid(spark, sf), a, per_radius=2.0)


@query("standardise", f"{TG}, m as (select channel, avg(v) as mean, stddev_pop(v) as sd from tgrid group by 1) select channel, row, col, case when sd > 0 then (v - mean) / sd else 0 end as z from tgrid join m using (channel)", "z")
def standardise(spark, sf):
    """Rasters with mean 0 and deviation 1."""
    g = v.typed_grid(spark, sf)
    m = g.groupBy("channel").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    return g.join(F.broadcast(m), "channel").select("channel", "row", "col", F.when(F.col("sd") > 0, (F.col("v") - F.col("mean")) / F.col("sd")).otherwise(0.0).alias("z"))


_IN = (1600.0, 1000.0, 2800.0, 4000.0)


@query("apron_coverage", f"with {v.CELLS}, f as (select type_id as channel, x between 1600 and 2800 and y between 1000 and 4000 as i, x between 1450 and 2950 and y between 850 and 4150 as w from cells), s as (select channel, count(*) filter (where i)::double as mass, count(*) filter (where w and not i)::double as apron from f group by 1) select channel, mass, apron, (apron / {1500 * 3300 - 1200 * 3000}) / (mass / {1200 * 3000}) as coverage from s", "coverage")
def apron_coverage(spark, sf):
    """Density in the margin of a window against that inside."""
    return density.apron_coverage(_channels(spark, sf), _IN, 150.0)


_CROSS = "a as (select * from cells where type_id = 0), b as (select * from cells where type_id = 1)"


def _two(spark, sf):
    c = v.cells(spark, sf)
    return c.where("type_id = 0"), c.where("type_id = 1")


@query("kernel_marks", f"with {v.CELLS}, {_CROSS}, p as (select a.cell_id, 3 / {math.pi * 3600!r}::double * pow(1 - ((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) / 3600, 2) as k from a join b on b.x between a.x - 60 and a.x + 60 and (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) < 3600) select a.cell_id, a.x, a.y, coalesce(sum(k), 0) / ((select count(*) from b) / {_AREA!r}) as m from a left join p using (cell_id) group by 1, 2, 3", "m")
def kernel_marks(spark, sf):
    """Kernel-weighted neighbours against the density."""
    from quadrille.functions.scales import kernel

    a, b = _two(spark, sf)
    return pcf.cross_marks(a, b, v.BBOX, 60.0, kernel=lambda d2: kernel(d2, 60.0, 2))


def _map_sql(mark: str) -> str:
    s = 1 / (80 * math.sqrt(2 * math.pi))
    return f"with {v.CELLS}, {_CROSS}, p as (select a.cell_id, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) as d2 from a join b on b.x between a.x - 60 and a.x + 60 and (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) < 3600), raw as (select a.cell_id, a.x, a.y, coalesce(count(p.d2), 0) / {math.pi * 3600!r} / ((select count(*) from b) / {_AREA!r}) as m from a left join p using (cell_id) group by 1, 2, 3), marks as (select *, {mark} as mm from raw), pix as (select r.i::int as row, c.i::int as col, {X0} + (c.i + 0.5) * {(X1 - X0) / 48} as px, {Y0} + (r.i + 0.5) * {(Y1 - Y0) / 48} as py from range(48) r(i) cross join range(48) c(i)), k as (select row, col, sum(mm * {s!r} * exp(-({_D2}) / 12800)) as s from pix join marks on {_D2} <= 57600 group by 1, 2) select pix.row, pix.col, coalesce(s, 0)::double as v from pix left join k using (row, col)"


@query("tcm_map", _map_sql("case when m >= 5 then 1.0 when m > 1 then (m - 1) / 4 when m <= 0.2 then -1.0 else (1 - 1 / m) / 4 end"), "v")
def tcm_map(spark, sf):
    """Map of where two types attract or avoid each other."""
    a, b = _two(spark, sf)
    marks = pcf.cross_marks(a, b, v.BBOX, 60.0).withColumn("m", pcf.mark_to_m(F.col("m"), 5.0))
    return density.correlation_map(marks, v.BBOX, 48, 48, 80.0)


@query("tcm_kernel", _map_sql("m"), "v")
def tcm_kernel(spark, sf):
    """The same of unmapped marks."""
    a, b = _two(spark, sf)
    return density.correlation_map(pcf.cross_marks(a, b, v.BBOX, 60.0), v.BBOX, 48, 48, 80.0)


def _images(spark, sf):
    return v.typed_grid(spark, sf).withColumnRenamed("channel", "grid_id")


@query("fdwt")
def fdwt(spark, sf):
    """Forward wavelet transform of each type's raster."""
    return grids.wavelet(_images(spark, sf), 3, "5/3")


@query("idwt_roundtrip", f"{TG} select channel as grid_id, row, col, v from tgrid", "v")
def idwt_roundtrip(spark, sf):
    """Forward and back."""
    return grids.wavelet(grids.wavelet(_images(spark, sf), 3, "9/7"), 3, "9/7", back=True)


@query("threshold_detail", f"{TG} select channel, row, col, case when row < 4 and col < 4 then v else sign(v) * greatest(abs(v) - 1.5, 0) end as v from tgrid", "v")
def threshold_detail(spark, sf):
    """Shrinking of all but the coarsest band."""
    return grids.threshold_detail(v.typed_grid(spark, sf), 32, 32, 3, 1.5)


@query("dwt_bands", "select * from (values ('LL', 2, 0, 0, 8, 6), ('HL', 2, 8, 0, 8, 6), ('LH', 2, 0, 6, 8, 6), ('HH', 2, 8, 6, 8, 6), ('HL', 1, 16, 0, 16, 12), ('LH', 1, 0, 12, 16, 12), ('HH', 1, 16, 12, 16, 12)) t(band, level, x, y, width, height)")
def dwt_bands(spark, sf):
    """Rectangles of a packed transform."""
    return spark.createDataFrame(grids.dwt_bands(32, 24, 2), "band string, level int, x int, y int, width int, height int")


_RD = f"rd as (select row, col, 1 - least(1.0, v / 20) * 0.5 as u, least(1.0, v / 20) * 0.25 as v from grid)"


def _state(spark, sf):
    s = F.least(F.lit(1.0), F.col("v") / 20)
    return v.grid(spark, sf).select("row", "col", (1 - s * 0.5).alias("u"), (s * 0.25).alias("v"))


@query("gray_scott_step", f"{G}, {_RD} select o.row, o.col, o.u + 0.16 * (e.u + w.u + s.u + n.u - 4 * o.u) - o.u * o.v * o.v + 0.035 * (1 - o.u) as u, o.v + 0.08 * (e.v + w.v + s.v + n.v - 4 * o.v) + o.u * o.v * o.v - 0.1 * o.v as v from {_near('rd')}", "u v")
def gray_scott_step(spark, sf):
    """One step of reaction and diffusion."""
    return grids.gray_scott(_state(spark, sf), 1)


def _scott_sql(steps: int) -> str:
    """Chained steps, each the SQL of one."""
    step = lambda k: f"s{k + 1} as materialized (select o.row, o.col, o.u + 0.16 * (e.u + w.u + s.u + n.u - 4 * o.u) - o.u * o.v * o.v + 0.035 * (1 - o.u) as u, o.v + 0.08 * (e.v + w.v + s.v + n.v - 4 * o.v) + o.u * o.v * o.v - 0.1 * o.v as v from {_near(f's{k}')})"
    return f"{G}, {_RD}, s0 as materialized (select * from rd), {', '.join(map(step, range(steps)))} select * from s{steps}"


@query("gray_scott_run", _scott_sql(12), "u v")
def gray_scott_run(spark, sf):
    """Twelve steps."""
    return grids.gray_scott(_state(spark, sf), 12, every=4)


_SX, _SY = (X1 - X0) / N, (Y1 - Y0) / N
_MASKED = f"""{G}, mask as (select row, col, {X0!r}::double + col * {_SX!r}::double as px, {Y1!r}::double - (row + 1) * {_SY!r}::double as py from grid where v > 3),
    near as (select cell_id, c.x - px as dx, c.y - py as dy from cells c join mask on c.type_id = 0 and c.x between px - 150 and px + {_SX!r} + 150 and c.y between py - 150 and py + {_SY!r} + 150),
    part as (select cell_id, {disk_rect_sql('dx', 'dy', '150.0::double', (0.0, 0.0, _SX, _SY))} as area from near)
    select cell_id, coalesce(sum(area), 0) as area from cells left join part using (cell_id) where type_id = 0 group by 1"""


@query("annulus_mask_domain", _MASKED, "area", 4)
def annulus_mask_domain(spark, sf):
    """Area of a disk of 150 about each cell of type 0 within the pixels of a mask; 0 where it meets none."""
    sx, sy = (X1 - X0) / N, (Y1 - Y0) / N
    mask = v.grid(spark, sf).where("v > 3").select("row", "col")
    points = _two(spark, sf)[0]
    near = density.deposits(points, v.BBOX, N, N, 150.0 + max(sx, sy), ["cell_id", "x", "y"]).join(F.broadcast(mask), ["row", "col"])
    # the pixel moved to the origin stands for the pixel where it lies
    px, py = F.col("x") - (X0 + F.col("col") * sx), F.col("y") - (Y1 - (F.col("row") + 1) * sy)
    sums = near.groupBy("cell_id").agg(F.sum(disk_rect_area(px, py, F.lit(150.0), (0.0, 0.0, sx, sy))).alias("area"))
    return points.select("cell_id").join(sums, "cell_id", "left").fillna(0.0, ["area"])
