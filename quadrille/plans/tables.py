"""Queries on tables and columns: scans, masks, scans in order, sparse matrices, bins, algebra, units."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from quadrille import views as v
from quadrille.checkpoints import folder
from quadrille.functions import algebra, masks, scales
from quadrille.functions import geometry as geo
from quadrille.operators import density, lattice
from quadrille.plans.registry import query
from quadrille.sources import cells_csv, matrices

X0, Y0, X1, Y1 = v.BBOX
C = f"with {v.CELLS}"


@query("points_source", f"{C} select cell_id, x, y from cells")
def points_source(spark, sf):
    """Centroids as points."""
    return v.cells(spark, sf).select("cell_id", "x", "y")


@query("n_obs", "select count(*) as n from orders")
def n_obs(spark, sf):
    """Rows of the cell table."""
    return v.table(spark, sf, "orders").agg(F.count("*").alias("n"))


@query("csv_profile", "select 0 as place, 'o_orderkey' as name, avg((try_cast(o_orderkey::varchar as double) is not null)::int)::double as numeric_fraction, count(distinct o_orderkey) as distinct from orders union all select 1, 'o_orderstatus', avg((try_cast(o_orderstatus as double) is not null)::int)::double, count(distinct o_orderstatus) from orders union all select 2, 'o_orderpriority', avg((try_cast(o_orderpriority as double) is not null)::int)::double, count(distinct o_orderpriority) from orders", "numeric_fraction")
def csv_profile(spark, sf):
    """Numeric share and distinct values of columns."""
    return cells_csv.profile(v.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"))


@query("csv_group_cells", "select o_orderpriority as type, count(*) as n, min(o_orderkey) as first_row, avg(o_totalprice) as mean_x, avg(o_custkey::double) as mean_y from orders group by 1", "mean_x mean_y")
def csv_group_cells(spark, sf):
    """Cells by type with the rows that lack one skipped."""
    return cells_csv.grouped(v.table(spark, sf, "orders"), "o_totalprice", "o_custkey", "o_orderpriority", "o_orderkey")


@query("assign_keys", "select p_partkey as i, p_brand as name, regexp_replace(p_brand, '[^A-Za-z0-9._-]', '_', 'g') || case when row_number() over (partition by regexp_replace(p_brand, '[^A-Za-z0-9._-]', '_', 'g') order by p_partkey) > 1 then '__' || row_number() over (partition by regexp_replace(p_brand, '[^A-Za-z0-9._-]', '_', 'g') order by p_partkey) else '' end as key from part")
def assign_keys(spark, sf):
    """Safe unique names."""
    return cells_csv.assigned_keys(v.table(spark, sf, "part").select(F.col("p_partkey").alias("i"), F.col("p_brand").alias("name")))


@query("region_cells", f"{C} select region, case lower(region) when 'o' then 0 when 'f' then 1 end::int as type_id, count(*) as n from cells where lower(region) in ('o', 'f') group by 1, 2")
def region_cells(spark, sf):
    """Labels mapped to a caller's axis whatever their case, others dropped."""
    return matrices.remapped(v.cells(spark, sf).drop("type_id"), "region", ["o", "f"], ignore_case=True).groupBy("region", "type_id").agg(F.count("*").alias("n"))


@query("categorical_decode", "select n_name as label, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1")
def categorical_decode(spark, sf):
    """A code column with its labels."""
    labels = v.table(spark, sf, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    return v.table(spark, sf, "customer").select(F.col("c_nationkey").alias("code")).join(F.broadcast(labels), "code").groupBy("label").agg(F.count("*").alias("n"))


def _x(spark, sf):
    return v.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), F.col("l_linenumber").alias("var")).agg(F.sum("l_quantity").alias("value"))


_X = "x as (select l_suppkey as cell, l_linenumber as var, sum(l_quantity) as value from lineitem group by 1, 2)"


@query("matrix_read", f"with {_X} select cell, var::int as var, value from x", "value")
def matrix_read(spark, sf):
    """A sparse matrix, stored as compressed rows, as long rows."""
    path = f"{folder(spark)}/matrix-{uuid.uuid4().hex}"
    matrices.to_csr(_x(spark, sf), "cell", "var", "value").write.parquet(path)
    return matrices.read_matrix(spark, path).select("cell", F.col("var").cast("int").alias("var"), "value")


@query("sparse_select_columns", f"with {_X}, n as (select count(*) as n from supplier), w as (select * from (values (0, 3), (1, 1), (2, 3), (3, 99)) w(place, var)) select c.i as cell, w.place, w.var, coalesce(value, 0) as value from (select unnest(range(n)) as i from n) c cross join w left join x on x.cell = c.i and x.var = w.var", "value")
def sparse_select_columns(spark, sf):
    """Wanted columns of a sparse matrix, densely."""
    return matrices.select_columns(_x(spark, sf), v.table(spark, sf, "supplier").count(), [3, 1, 3, 99])


@query("dense_select_columns", f"with {v.VECTORS} select id, v[6] as a, v[1] as b from vectors")
def dense_select_columns(spark, sf):
    """Wanted columns of dense rows."""
    return v.vectors(spark, sf).select("id", F.get("v", F.lit(5)).alias("a"), F.get("v", F.lit(0)).alias("b"))


@query("column_stats", f"with {_X} select var, sum(value) as total, greatest(max(value), 0) as most, count(*) filter (where value <> 0) as non_zero from x group by 1", "total most")
def column_stats(spark, sf):
    """Sum, maximum and non-zero entries of columns."""
    return matrices.column_stats(_x(spark, sf))


@query("coo_to_csr", f"with {_X}, l as (select cell as row, list(var order by var) as columns, list(value order by var) as weights, count(*) as n from x group by 1) select row, coalesce(sum(n) over (order by row rows between unbounded preceding and 1 preceding), 0)::bigint as \"begin\", columns, weights from l")
def coo_to_csr(spark, sf):
    """Edges as sorted rows with offsets."""
    return matrices.to_csr(_x(spark, sf), "cell", "var", "value")


@query("subset_rows", f"with {v.VECTORS} select id, label from vectors where id % 7 = 3")
def subset_rows(spark, sf):
    """Rows of a list of ids."""
    ids = v.vectors(spark, sf).select(F.col("id")).where(F.col("id") % 7 == 3)
    return v.vectors(spark, sf).join(ids, "id", "left_semi").select("id", "label")


@query("subset_columns", f"with {v.VECTORS} select id, [v[3], v[1], v[10]] as w from vectors")
def subset_columns(spark, sf):
    """Entries of every vector."""
    return v.vectors(spark, sf).select("id", F.transform(F.array(F.lit(2), F.lit(0), F.lit(9)), lambda i: F.get("v", i)).alias("w"))


@query("mask_range", f"{C} select cell_id, (x between 1500 and 2500)::int::double as m from cells")
def mask_range(spark, sf):
    """1 inside a closed range."""
    return v.cells(spark, sf).select("cell_id", masks.in_range(F.col("x"), 1500, 2500).alias("m"))


_SMOOTH = "least(1.0, greatest(0.0, (x - ({e} - 200.0)) / 400.0))"


def _step(e: int) -> str:
    t = _SMOOTH.format(e=e)
    return f"({t} * {t} * (3 - 2 * {t}))"


@query("mask_range_soft", f"{C} select cell_id, {_step(1500)} * (1 - {_step(2500)}) as m from cells", "m")
def mask_range_soft(spark, sf):
    """Smooth steps at both ends of a range."""
    return v.cells(spark, sf).select("cell_id", masks.in_range(F.col("x"), 1500, 2500, 200).alias("m"))


@query("mask_equals", f"{C} select cell_id, (abs(type_id - 2) <= 0.5)::int::double as m from cells")
def mask_equals(spark, sf):
    """1 where a code is met."""
    return v.cells(spark, sf).select("cell_id", masks.equals(F.col("type_id"), 2).alias("m"))


@query("mask_count", f"{C} select count(*) filter (where m > 0.5) as n, sum(m) as weight from (select {_step(1500)} * (1 - {_step(2500)}) as m from cells)", "weight", 3)
def mask_count(spark, sf):
    """Rows selected and their weight."""
    return mask_range_soft(spark, sf).agg(F.count_if(F.col("m") > 0.5).alias("n"), F.sum("m").alias("weight"))


def _two(spark, sf):
    return v.cells(spark, sf).select("cell_id", masks.in_range(F.col("x"), 1500, 2500, 200).alias("a"), masks.threshold(F.col("y"), 2500, True, 0.002).alias("b"))


_TWO = f"two as (select cell_id, {_step(1500)} * (1 - {_step(2500)}) as a, 1 / (1 + exp(-(y - 2500) * 0.002)) as b from cells)"


@query("mask_and", f"{C}, {_TWO} select cell_id, least(a, b) as m from two", "m")
def mask_and(spark, sf):
    return _two(spark, sf).select("cell_id", masks.both(F.col("a"), F.col("b")).alias("m"))


@query("mask_or", f"{C}, {_TWO} select cell_id, greatest(a, b) as m from two", "m")
def mask_or(spark, sf):
    return _two(spark, sf).select("cell_id", masks.either(F.col("a"), F.col("b")).alias("m"))


@query("mask_not", f"{C}, {_TWO} select cell_id, 1 - a as m from two", "m")
def mask_not(spark, sf):
    return _two(spark, sf).select("cell_id", masks.inverted(F.col("a")).alias("m"))


@query("threshold", f"{C} select cell_id, (y >= 2500)::int::double as m from cells")
def threshold(spark, sf):
    return v.cells(spark, sf).select("cell_id", masks.threshold(F.col("y"), 2500).alias("m"))


@query("threshold_soft", f"{C} select cell_id, 1 / (1 + exp(-(y - 2500) * 0.002)) as m from cells", "m")
def threshold_soft(spark, sf):
    return v.cells(spark, sf).select("cell_id", masks.threshold(F.col("y"), 2500, True, 0.002).alias("m"))


@query("stream_compact", f"{C} select cell_id, (row_number() over (order by cell_id) - 1)::bigint as place from cells where type_id > 2")
def stream_compact(spark, sf):
    """Ids of the selected rows, ascending, with their places."""
    held = v.cells(spark, sf).select("cell_id", (F.col("type_id") > 2).cast("int").alias("m"))
    return lattice.exclusive_scan(held, "cell_id", "m").where("m = 1").select("cell_id", F.col("scan").alias("place"))


@query("exclusive_scan", f"{C} select cell_id, type_id, coalesce(sum(type_id) over (order by cell_id rows between unbounded preceding and 1 preceding), 0)::bigint as scan, (sum(type_id) over ())::bigint as total from cells")
def exclusive_scan(spark, sf):
    """Running sums in two passes."""
    return lattice.exclusive_scan(v.cells(spark, sf).select("cell_id", "type_id"), "cell_id", "type_id").select("cell_id", "type_id", "scan", "total")


@query("mask_where", f"with {v.grid_sql()} select row, col from grid where v > 3")
def mask_where(spark, sf):
    """Pixels above a value."""
    return v.grid(spark, sf).where("v > 3").select("row", "col")


_W = {1: ("alpha", 1.0), 2: ("alpha", 2.0), 3: ("beta", 0.5), 4: ("gamma", 1.0)}
_WSQL = "w as (select * from (values (1, 'alpha', 1.0::double), (2, 'alpha', 2.0), (3, 'beta', 0.5), (4, 'gamma', 1.0)) w(code, channel, weight))"


def _mbox(spark, sf):
    parts = v.table(spark, sf, "part").count()
    return (0.0, 0.0, float(parts), float(v.table(spark, sf, "supplier").count()))


_MB = "b as (select (select count(*) from part)::double as bx, (select count(*) from supplier)::double as \"by\")"


@query("transcript_channels", f'with {v.MOLECULES}, {_WSQL}, {_MB} select channel, count(*) as n, sum(weight / coalesce(fraction, 1)) as w from molecules join w using (code), b where x between 0.25 * bx - 5 and 0.75 * bx + 5 and y between 0.25 * "by" - 5 and 0.75 * "by" + 5 and qv >= 10 group by 1', "w", 3)
def transcript_channels(spark, sf):
    """Molecules of a window by channel."""
    b = _mbox(spark, sf)
    return density.transcript_channels(v.molecules(spark, sf), _W, (0.25 * b[2], 0.25 * b[3], 0.75 * b[2], 0.75 * b[3]), 5.0, 10.0)[0].groupBy("channel").agg(F.count("*").alias("n"), F.sum("w").alias("w"))


@query("transcript_stats", f'with {v.MOLECULES}, {_MB}, f as (select x between 0.25 * bx - 5 and 0.75 * bx + 5 and y between 0.25 * "by" - 5 and 0.75 * "by" + 5 as near, qv >= 10 as good, code in (1, 2, 3, 4) as wanted from molecules, b) select count(*) as considered, count(*) filter (where not near) as out_of_reach, count(*) filter (where near and not good) as below_minimum, count(*) filter (where near and good and not wanted) as unselected from f')
def transcript_stats(spark, sf):
    """Why molecules were left out."""
    b = _mbox(spark, sf)
    return density.transcript_channels(v.molecules(spark, sf), _W, (0.25 * b[2], 0.25 * b[3], 0.75 * b[2], 0.75 * b[3]), 5.0, 10.0)[1]


_BINS = f'{v.MOLECULES}, {_WSQL}, {_MB}, bins as (select (floor(y / 20) * ceil(bx / 20) + least(ceil(bx / 20) - 1, floor(x / 20)))::bigint as bin, channel, sum(weight / coalesce(fraction, 1)) as count, count(*) as sampled, any_value(ceil(bx / 20))::int as nx from molecules join w using (code), b where x between 0 and bx and y between 0 and "by" and qv >= 10 group by 1, 2)'


def _bins(spark, sf):
    return density.channel_bins(v.molecules(spark, sf), _W, 20.0, _mbox(spark, sf), 10.0)


@query("channel_bins", f"with {_BINS} select bin, channel, count, sampled from bins", "count")
def channel_bins(spark, sf):
    """Weighted molecules by bin and channel."""
    return _bins(spark, sf)


@query("pooled_bins", f"with {_BINS}, p as (select bin % nx + i as bx, bin // nx + j as \"by\", channel, count, nx from bins cross join (select unnest(range(-1, 2)) as i) cross join (select unnest(range(-1, 2)) as j)), s as (select \"by\" * nx + bx as bin, channel, sum(count) as count from p where bx between 0 and nx - 1 group by 1, 2) select bin::bigint as bin, channel, count from s where bin in (select bin from bins)", "count")
def pooled_bins(spark, sf):
    """Sums over neighbouring bins."""
    return density.pooled_bins(_bins(spark, sf), math.ceil(_mbox(spark, sf)[2] / 20))


@query("bin_composition", f"with {_BINS} select bin, channel, sqrt(count / sum(count) over (partition by bin)) as root, case when sum(sampled) over (partition by bin) >= 20 then sum(count) over (partition by bin) else 0 end as weight from bins", "root weight")
def bin_composition(spark, sf):
    """Root shares of channels in bins."""
    return density.bin_composition(_bins(spark, sf), 20)


@query("bucket_points", f"{C} select (case when x = {X1} then 15 else floor((x - {X0}) / {X1 - X0} * 16) end)::int as tile_x, (case when y = {Y1} then 15 else floor((y - {Y0}) / {Y1 - Y0} * 16) end)::int as tile_y, count(*) as n from cells where x between {X0} and {X1} and y between {Y0} and {Y1} group by 1, 2")
def bucket_points(spark, sf):
    """Points by the tile that owns them."""
    return density.tiles(v.cells(spark, sf), v.BBOX, 16, 16).groupBy("tile_x", "tile_y").agg(F.count("*").alias("n"))


@query("select_tiles", f"{C}, t as (select (case when x = {X1} then 15 else floor((x - {X0}) / {X1 - X0} * 16) end)::int as tile_x, (case when y = {Y1} then 15 else floor((y - {Y0}) / {Y1 - Y0} * 16) end)::int as tile_y, count(*) as n from cells where x between {X0} and {X1} and y between {Y0} and {Y1} group by 1, 2) select tile_x, tile_y, n, sqrt(pow({X0} + (tile_x + 0.5) * {(X1 - X0) / 16} - 2000, 2) + pow({Y0} + (tile_y + 0.5) * {(Y1 - Y0) / 16} - 2000, 2)) as d from t where {X0} + tile_x * {(X1 - X0) / 16} <= 2310 and {X0} + (tile_x + 1) * {(X1 - X0) / 16} >= 1690 and {Y0} + tile_y * {(Y1 - Y0) / 16} <= 2810 and {Y0} + (tile_y + 1) * {(Y1 - Y0) / 16} >= 1190", "d")
def select_tiles(spark, sf):
    """Tiles that meet a window and its margin, by distance from its centre."""
    sx, sy = (X1 - X0) / 16, (Y1 - Y0) / 16
    t = bucket_points(spark, sf).where((X0 + F.col("tile_x") * sx <= 2310) & (X0 + (F.col("tile_x") + 1) * sx >= 1690) & (Y0 + F.col("tile_y") * sy <= 2810) & (Y0 + (F.col("tile_y") + 1) * sy >= 1190))
    return t.withColumn("d", F.hypot(X0 + (F.col("tile_x") + 0.5) * sx - 2000, Y0 + (F.col("tile_y") + 0.5) * sy - 2000)).orderBy("d", "tile_x", "tile_y")


@query("points_grid", f"{C}, s as (select max(x) - min(x) as sx, count(*)::double as n from cells) select n::bigint as n, greatest(0, floor(log2(greatest(1.0, n / 1000)) / 2))::bigint as level from s")
def points_grid(spark, sf):
    """Quadtree level at which a tile holds 1000 rows on average."""
    s = v.cells(spark, sf).agg(F.count("*").alias("n"))
    return s.select("n", F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.lit(1.0), F.col("n") / 1000)) / 2)).cast("long").alias("level"))


@query("channels_from_labels", f"{C} select 'type' || type_id as channel, count(*) as n from cells group by 1")
def channels_from_labels(spark, sf):
    """One channel for each type."""
    return v.cells(spark, sf).groupBy(F.concat(F.lit("type"), F.col("type_id")).alias("channel")).agg(F.count("*").alias("n"))


@query("channels_from_expression", f"{C} select cell_id, 'gene_a' as channel, w from cells union all select cell_id, 'gene_b', y / 100 from cells", "w", 9)
def channels_from_expression(spark, sf):
    """A channel for each expression column over shared points."""
    return v.cells(spark, sf).select("cell_id", F.col("w").alias("gene_a"), (F.col("y") / 100).alias("gene_b")).unpivot("cell_id", ["gene_a", "gene_b"], "channel", "w")


_PAIR = "p as (select a.id, a.v as v, b.v as u from vectors a join vectors b on b.id = a.id + 1)"


def _pair(spark, sf):
    a = v.vectors(spark, sf)
    return a.select("id", "v").join(a.select((F.col("id") - 1).alias("id"), F.col("v").alias("u")), "id")


def _pairwise(name, column, text, rounded="r"):
    @query(name, f"with {v.VECTORS}, {_PAIR} select id, {text} as r from p", rounded)
    def run(spark, sf):
        return _pair(spark, sf).select("id", column().alias("r"))

    run.__doc__ = name
    return run


_pairwise("add_fields", lambda: algebra.added(F.col("v"), F.col("u")), "list_transform(list_zip(v, u), lambda z: z[1] + z[2])", "")
_pairwise("sub_fields", lambda: algebra.subtracted(F.col("v"), F.col("u")), "list_transform(list_zip(v, u), lambda z: z[1] - z[2])", "")
_pairwise("scale_field", lambda: algebra.scaled(F.col("v"), 2.5), "list_transform(v, lambda x: x * 2.5)", "")
_pairwise("mul_scalar", lambda: F.zip_with("v", "u", lambda a, b: a * b), "list_transform(list_zip(v, u), lambda z: z[1] * z[2])", "")
_pairwise("dot_fields", lambda: algebra.dot(F.col("v"), F.col("u")), "list_inner_product(v, u)")
_pairwise("normalize_field", lambda: F.transform(algebra.normalized(F.col("v")), lambda x: F.round(x, 6) + F.lit(0.0)), "list_transform(v, lambda x: round(x / sqrt(list_inner_product(v, v)), 6) + 0.0::double)", "")
_pairwise("magnitude", lambda: algebra.norm(F.col("v")), "sqrt(list_inner_product(v, v))")


def _c(n):
    return algebra.complex_of(F.col(n)[0], F.col(n)[1])


def _q(n):
    return algebra.quaternion(*[F.col(n)[i] for i in range(4)])


@query("cross_fields", f"with {v.VECTORS}, {_PAIR} select id, v[2]*u[3]-v[3]*u[2] as x, v[3]*u[1]-v[1]*u[3] as y, v[1]*u[2]-v[2]*u[1] as z from p", "x y z")
def cross_fields(spark, sf):
    """Cross products."""
    c = algebra.cross(F.slice("v", 1, 3), F.slice("u", 1, 3))
    return _pair(spark, sf).select("id", c[0].alias("x"), c[1].alias("y"), c[2].alias("z"))


@query("mul_complex", f"with {v.VECTORS}, {_PAIR} select id, v[1]*u[1]-v[2]*u[2] as re, v[1]*u[2]+v[2]*u[1] as im from p", "re im")
def mul_complex(spark, sf):
    """Complex products."""
    return _pair(spark, sf).select("id", algebra.times_complex(_c("v"), _c("u")).alias("c")).select("id", "c.re", "c.im")


@query("mul_quaternion", f"with {v.VECTORS}, {_PAIR} select id, v[1]*u[1]-v[2]*u[2]-v[3]*u[3]-v[4]*u[4] as w, v[1]*u[2]+v[2]*u[1]+v[3]*u[4]-v[4]*u[3] as x, v[1]*u[3]-v[2]*u[4]+v[3]*u[1]+v[4]*u[2] as y, v[1]*u[4]+v[2]*u[3]-v[3]*u[2]+v[4]*u[1] as z from p", "w x y z")
def mul_quaternion(spark, sf):
    """Hamilton products."""
    return _pair(spark, sf).select("id", algebra.times_quaternion(_q("v"), _q("u")).alias("q")).select("id", "q.w", "q.x", "q.y", "q.z")


@query("complex_pack", f"with {v.VECTORS} select id, {{'re': v[1], 'im': v[2]}} as c from vectors")
def complex_pack(spark, sf):
    return v.vectors(spark, sf).select("id", _c("v").alias("c"))


@query("real_part", f"with {v.VECTORS} select id, v[1] as r from vectors")
def real_part(spark, sf):
    return v.vectors(spark, sf).select("id", _c("v")["re"].alias("r"))


@query("imag_part", f"with {v.VECTORS} select id, v[2] as r from vectors")
def imag_part(spark, sf):
    return v.vectors(spark, sf).select("id", _c("v")["im"].alias("r"))


@query("conjugate", f"with {v.VECTORS} select id, v[1] as re, -v[2] as im, v[1] as w, -v[2] as x from vectors")
def conjugate(spark, sf):
    c, q = algebra.conjugate(_c("v")), algebra.conjugate(_q("v"), True)
    return v.vectors(spark, sf).select("id", c["re"].alias("re"), c["im"].alias("im"), q["w"].alias("w"), q["x"].alias("x"))


@query("bundle_combine", f"{C} select cell_id, {{'x': x, 'y': y}} as bundle from cells")
def bundle_combine(spark, sf):
    """Parts as one composite value."""
    return v.cells(spark, sf).select("cell_id", F.struct("x", "y").alias("bundle"))


@query("bundle_extract", f"{C} select cell_id, y from cells")
def bundle_extract(spark, sf):
    """A part of a composite value."""
    return bundle_combine(spark, sf).select("cell_id", "bundle.y")


@query("kernel_at", f"{C} select cell_id, case when x - 1096 < 900 then 3 / {math.pi * 900!r}::double * pow(1 - (x - 1096) / 900, 2) else 0 end as k2, case when x - 1096 < 900 then 1 / {math.pi * 900!r}::double else 0 end::double as k0 from cells", "k2 k0", 9)
def kernel_at(spark, sf):
    """Kernels at squared distances."""
    d2 = F.col("x") - 1096
    return v.cells(spark, sf).select("cell_id", scales.kernel(d2, 30.0, 2).alias("k2"), scales.kernel(d2, 30.0, 0).alias("k0"))


@query("kernel_moments", f"select i::int as degree, 900.0::double / (i + 2) as moment2, (i + 1) * (i + 1)::double / ((2 * i + 1) * {math.pi!r} * 900) as roughness, 30 * sqrt((i + 2)::double / 2) as equivalent_radius from range(4) r(i)", "moment2 roughness equivalent_radius")
def kernel_moments(spark, sf):
    """Moments of the polynomial kernels of radius 30."""
    rows = [(k, scales.moment2(30.0, k), scales.roughness(30.0, k), scales.equivalent_radius(30.0, k)) for k in range(4)]
    return spark.createDataFrame(rows, "degree int, moment2 double, roughness double, equivalent_radius double")


@query("cell_center", f"with {v.grid_sql()} select row, col, {X0} + (col + 0.5) * {(X1 - X0) / 64} as x, {Y1} - (row + 0.5) * {(Y1 - Y0) / 64} as y from grid", "x y")
def cell_center(spark, sf):
    """World coordinates of pixels."""
    x, y = scales.cell_center(F.col("col"), F.col("row"), v.BBOX, 64, 64)
    return v.grid(spark, sf).select("row", "col", x.alias("x"), y.alias("y"))


@query("raster_size", f"select least(2048, greatest(16, ceil({X1 - X0} * 3 / 20)))::int as width, least(2048, greatest(16, ceil({Y1 - Y0} * 3 / 20)))::int as height, 2048 * 20.0::double / 3 as widest, 40.0::double as effective_radius", "widest")
def raster_size(spark, sf):
    """Pixels that resolve a radius of 20."""
    w, h = scales.raster_size(X1 - X0, Y1 - Y0, 20.0)
    return spark.createDataFrame([(w, h, 2048 * 20.0 / 3, 40.0)], "width int, height int, widest double, effective_radius double")


_M = (1.5, 0.25, -3.0, -0.5, 2.0, 7.0)
_N = (0.5, 0.0, 10.0, 0.1, 0.9, -2.0)


@query("affine_compose", f"{C}, one as (select cell_id, 1.5 * x + 0.25 * y - 3 as x, -0.5 * x + 2 * y + 7 as y from cells) select cell_id, 0.5 * x + 10 as x, 0.1 * x + 0.9 * y - 2 as y from one", "x y", 8)
def affine_compose(spark, sf):
    """Two maps as one."""
    x, y = geo.mapped(geo.compose(_M, _N), F.col("x"), F.col("y"))
    return v.cells(spark, sf).select("cell_id", x.alias("x"), y.alias("y"))


@query("affine_invert", f"{C} select cell_id, x, y from cells", "x y")
def affine_invert(spark, sf):
    """A map and its inverse."""
    a, b = geo.mapped(_M, F.col("x"), F.col("y"))
    x, y = geo.mapped(geo.inverse(_M), F.col("a"), F.col("b"))
    return v.cells(spark, sf).select("cell_id", a.alias("a"), b.alias("b")).select("cell_id", x.alias("x"), y.alias("y"))


@query("affine_rect", f"{C}, c as (select cell_id, 1.5 * (x + i) + 0.25 * (y + j) - 3 as u, -0.5 * (x + i) + 2 * (y + j) + 7 as w from cells cross join (values (0), (10)) a(i) cross join (values (0), (20)) b(j)) select cell_id, min(u) as x0, min(w) as y0, max(u) as x1, max(w) as y1 from c group by 1", "x0 y0 x1 y1")
def affine_rect(spark, sf):
    """Bounds of a mapped rectangle."""
    corners = [geo.mapped(_M, F.col("x") + i, F.col("y") + j) for i in (0, 10) for j in (0, 20)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return v.cells(spark, sf).select("cell_id", F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


@query("unit_factor", "select * from (values (0, 'mm', 1000.0::double), (1, 'Micrometer', 1.0), (2, 'furlong', null)) t(i, unit, factor)")
def unit_factor(spark, sf):
    """Micrometres in named units."""
    rows = spark.createDataFrame([(0, "mm"), (1, "Micrometer"), (2, "furlong")], "i int, unit string")
    return rows.select("i", "unit", scales.unit_factor(F.col("unit")).alias("factor"))


@query("convert_unit", f"{C} select cell_id, x / 1000 as mm from cells", "mm")
def convert_unit(spark, sf):
    return v.cells(spark, sf).select("cell_id", scales.convert(F.col("x"), F.lit("um"), F.lit("mm")).alias("mm"))


@query("warp_map", f"{C}, u as (select cell_id, least(1.0, greatest(0.0, y / 5000)) as u from cells) select cell_id, 1 + 9 * u as lin, pow(10.0, u) as exp, 1 + 9 * u * u as amp from u", "lin exp amp")
def warp_map(spark, sf):
    """Places on three scales."""
    u = F.col("y") / 5000
    return v.cells(spark, sf).select("cell_id", *[scales.warp(u, 1.0, 10.0, k).alias(k) for k in ("lin", "exp", "amp")])


@query("warp_unmap", f"{C}, u as (select cell_id, 1 + y / 600 as u from cells) select cell_id, (u - 1) / 9 as lin, log10(u) as exp, sqrt((u - 1) / 9) as amp from u", "lin exp amp", 9)
def warp_unmap(spark, sf):
    """Values back to places."""
    u = 1 + F.col("y") / 600
    return v.cells(spark, sf).select("cell_id", *[scales.unwarp(u, 1.0, 10.0, k).alias(k) for k in ("lin", "exp", "amp")])


_LAB = scales.oklab_sql("(abs(v[1]) - floor(abs(v[1])))", "(abs(v[2]) - floor(abs(v[2])))", "(abs(v[3]) - floor(abs(v[3])))")


@query("srgb_to_oklab", f"with {v.VECTORS} select id, {_LAB[0]} as l, {_LAB[1]} as a, {_LAB[2]} as b from vectors", "l a b")
def srgb_to_oklab(spark, sf):
    """Perceptual lightness and colour."""
    part = lambda i: F.abs(F.col("v")[i]) - F.floor(F.abs(F.col("v")[i]))
    return v.vectors(spark, sf).select("id", *[c.alias(n) for c, n in zip(scales.oklab(part(0), part(1), part(2)), "lab", strict=True)])


@query("categorical_hues", "select i::int as i, ((i * 360.0::double / 7 + 30) % 360) as hue from range(7) r(i)", "hue")
def categorical_hues(spark, sf):
    """Seven hues evenly around the circle."""
    return spark.range(7).select(F.col("id").cast("int").alias("i"), ((F.col("id") * 360.0 / 7 + 30) % 360).alias("hue"))


@query("tile_normalise", f"with {v.grid_sql()} select row, col, v / 65535.0 as s from grid", "s", 9)
def tile_normalise(spark, sf):
    """16-bit samples from 0 to 1."""
    return v.grid(spark, sf).select("row", "col", (F.col("v") / 65535.0).alias("s"))


@query("pack_points", f"{C} select count(*) as n, count(*) filter (where w > 0) as valid, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, max(w) as max_w from cells", "max_w")
def pack_points(spark, sf):
    """Bounds and largest weight of the valid points."""
    ok = F.col("w").isNotNull() & ~F.isnan("w") & ~F.isnan("x") & ~F.isnan("y")
    held = v.cells(spark, sf)
    pick = lambda f, c: f(F.when(ok, F.col(c)))
    return held.agg(F.count("*").alias("n"), F.count_if(ok & (F.col("w") > 0)).alias("valid"), pick(F.min, "x").alias("min_x"), pick(F.max, "x").alias("max_x"), pick(F.min, "y").alias("min_y"), pick(F.max, "y").alias("max_y"), pick(F.max, "w").alias("max_w"))
