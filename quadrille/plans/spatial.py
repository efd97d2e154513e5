"""Queries on point clouds: lattices, contacts, pair correlation, neighbours."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quadrille import views as v
from quadrille.functions import geometry as geo
from quadrille.operators import contact, lattice, neighbours, pcf
from quadrille.operators.range_join import k_nearest
from quadrille.plans.registry import query

R = 20.0
X0, Y0, X1, Y1 = v.BBOX
AREA = (X1 - X0) * (Y1 - Y0)
PAIRS = f"{v.CELLS}, pairs as (select a.cell_id as ida, b.cell_id as idb, a.type_id as ta, b.type_id as tb, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) as d2 from cells a join cells b on a.cell_id <> b.cell_id and b.x > a.x - 30 and b.x < a.x + 30 and (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) < {{r2}})"
TYPE_SPINE = "ks as (select a.i::int as a, b.i::int as b from range(5) a(i) cross join range(5) b(i))"
COUNTS = "cnt as (select type_id, count(*) as n from cells group by 1)"


@query(
    "contact_network",
    f"""with {PAIRS.format(r2=R * R)}, {TYPE_SPINE}, {COUNTS},
    s as (select ta as a, tb as b, case when ta = tb then count(*) // 2 else count(*) end as edges, count(distinct ida) as contacts from pairs group by 1, 2),
    f as (select ks.a, ks.b, coalesce(edges, 0)::bigint as edges, coalesce(contacts, 0)::bigint as contacts, coalesce(n, 0)::bigint as n_a from ks left join s on s.a = ks.a and s.b = ks.b left join cnt on cnt.type_id = ks.a)
    select a as type_a, b as type_b, edges, contacts, n_a, case when n_a > 0 then 100.0::double * contacts / n_a else 'nan'::double end as pct_contacts, case when n_a > 0 then edges::double / n_a else 'nan'::double end as mean_degree,
    case when sum(edges) over (partition by a) > 0 then 100.0::double * edges / (sum(edges) over (partition by a))::double else 'nan'::double end as network_pct from f""",
    "pct_contacts mean_degree network_pct",
)
def contact_network(spark, sf):
    """Contacts of all pairs of types within 20."""
    return contact.contact_network(v.cells(spark, sf), R, v.TYPES)


@query("contact_summary", f"with {PAIRS.format(r2=R * R)} select (select count(*) from cells) as n_cells, (select count(*) // 2 from pairs) as total_edges, 2.0::double * (select count(*) // 2 from pairs) / (select count(*) from cells) as graph_mean_degree", "graph_mean_degree")
def contact_summary(spark, sf):
    """Size of the contact network."""
    return contact.network_summary(v.cells(spark, sf), R)


@query("contact_edges", f"with {PAIRS.format(r2=R * R)} select ida as a_cell_id, idb as b_cell_id, ta as a_type_id, tb as b_type_id, sqrt(d2) as d from pairs where ida < idb", "d")
def contact_edges(spark, sf):
    """The contact network's edges."""
    e = contact.contact_pairs(v.cells(spark, sf), R)
    swap = F.col("a_cell_id") > F.col("b_cell_id")
    pick = lambda p, q: F.when(swap, F.col(q)).otherwise(F.col(p))
    return e.select(pick("a_cell_id", "b_cell_id").alias("a_cell_id"), pick("b_cell_id", "a_cell_id").alias("b_cell_id"), pick("a_type_id", "b_type_id").alias("a_type_id"), pick("b_type_id", "a_type_id").alias("b_type_id"), "d")


def _of(cells, t):
    return cells.where(F.col("type_id") == t)


_CROSS = f"a as (select * from cells where type_id = 0), b as (select * from cells where type_id = 1), p as (select a.cell_id, a.x as ax, a.y as ay, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) as d2 from a join b on b.x > a.x - 60 and b.x < a.x + 60 and (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) < 3600)"
_RING = f"({math.pi!r} * (10.0*(bin+1)*10.0*(bin+1) - 10.0*bin*10.0*bin))"
_G = f"coalesce(s, 0) / ((select count(*) from a)::double * (select count(*) from b) / {AREA!r})"


@query(
    "cross_pcf",
    f"with {v.CELLS}, {_CROSS}, h as (select least(5, floor(sqrt(d2) / 10))::int as bin, count(*) as n from p group by 1), k as (select i::int as bin from range(6) r(i)), z as (select k.bin, coalesce(n, 0)::bigint as n_pairs, coalesce(n, 0)::double / {_RING.replace('bin', 'k.bin')} as s from k left join h on h.bin = k.bin) select bin, (bin + 0.5::double) * 10 as r, n_pairs, {_G} as g from z",
    "g",
)
def cross_pcf(spark, sf):
    """Pair correlation of two types."""
    c = v.cells(spark, sf)
    return pcf.cross_pcf(_of(c, 0), _of(c, 1), v.BBOX, 60.0, 6)


@query(
    "cross_pcf_edge_corrected",
    f"""with {v.CELLS}, {_CROSS}, h as (select least(5, floor(sqrt(d2) / 10))::int as bin, ax, ay from p),
    i as (select bin, {geo.disk_rect_sql("ax", "ay", "((bin+1)*10.0::double)", v.BBOX)} - case when bin > 0 then {geo.disk_rect_sql("ax", "ay", "greatest(bin*10.0::double, 1e-300)", v.BBOX)} else 0 end as area from h),
    j as (select bin, count(*) as n, sum(case when area > 1e-9 then 1.0 / area else 0 end) as s from i group by 1), k as (select i::int as bin from range(6) r(i))
    select k.bin, (k.bin + 0.5::double) * 10 as r, coalesce(n, 0)::bigint as n_pairs, {_G} as g from k left join j on j.bin = k.bin""",
    "g",
)
def cross_pcf_edge_corrected(spark, sf):
    """Pair correlation of two types with rings cut by the window."""
    c = v.cells(spark, sf)
    return pcf.cross_pcf(_of(c, 0), _of(c, 1), v.BBOX, 60.0, 6, edge_corrected=True)


_INNER = (1296.0, 200.0, 3300.0, 4800.0)
_WITHIN = "x between 1296 and 3300 and y between 200 and 4800"


@query(
    "cross_pcf_polygon",
    f"""with {v.CELLS}, {_CROSS.replace("type_id = 0", "type_id = 0 and " + _WITHIN).replace("type_id = 1", "type_id = 1 and " + _WITHIN)}, h as (select least(5, floor(sqrt(d2) / 10))::int as bin, ax, ay from p),
    i as (select bin, {geo.disk_rect_sql("ax", "ay", "((bin+1)*10.0::double)", _INNER)} - case when bin > 0 then {geo.disk_rect_sql("ax", "ay", "greatest(bin*10.0::double, 1e-300)", _INNER)} else 0 end as area from h),
    j as (select bin, count(*) as n, sum(case when area > 1e-9 then 1.0 / area else 0 end) as s from i group by 1), k as (select i::int as bin from range(6) r(i))
    select k.bin, (k.bin + 0.5::double) * 10 as r, coalesce(n, 0)::bigint as n_pairs, coalesce(s, 0) / ((select count(*) from a)::double * (select count(*) from b) / {2004.0 * 4600.0!r}) as g from k left join j on j.bin = k.bin""",
    "g",
)
def cross_pcf_polygon(spark, sf):
    """Pair correlation of two types within a polygon, given with a vertex amid one of its sides."""
    c, (x0, y0, x1, y1) = v.cells(spark, sf).where(_WITHIN), _INNER
    return pcf.cross_pcf(_of(c, 0), _of(c, 1), v.BBOX, 60.0, 6, domain=[[(x0 - 1e-7, y0 - 1e-7), (x1 + 1e-7, y0 - 1e-7), (x1 + 1e-7, 2000.0), (x1 + 1e-7, y1 + 1e-7), (x0 - 1e-7, y1 + 1e-7)]])


@query("annulus_polygon", f"with {v.CELLS} select cell_id, {geo.disk_rect_sql('x', 'y', '150.0::double', (1400.0, 800.0, 3000.0, 4000.0))} - {geo.disk_rect_sql('x', 'y', '100.0::double', (1400.0, 800.0, 3000.0, 4000.0))} - {geo.disk_rect_sql('x', 'y', '150.0::double', (2000.0, 2000.0, 2400.0, 2600.0))} + {geo.disk_rect_sql('x', 'y', '100.0::double', (2000.0, 2000.0, 2400.0, 2600.0))} as area from cells", "area", 4)
def annulus_polygon(spark, sf):
    """Area of a ring about each cell within a polygon with a hole."""
    rings = [[(1400.0, 800.0), (3000.0, 800.0), (3000.0, 2500.0), (3000.0, 4000.0), (1400.0, 4000.0)], [(2000.0, 2000.0), (2400.0, 2000.0), (2400.0, 2600.0), (2000.0, 2600.0)]]
    area = lambda r: geo.disk_polygon_area(F.col("x"), F.col("y"), F.lit(r), rings)
    return v.cells(spark, sf).select("cell_id", (area(150.0) - area(100.0)).alias("area"))


@query(
    "pcf_matrix_edge_corrected",
    f"""with {v.CELLS}, {TYPE_SPINE}, {COUNTS}, p as (select a.type_id as ta, b.type_id as tb, a.x as ax, a.y as ay, least(2, floor(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) / 10))::int as bin from cells a join cells b on a.cell_id <> b.cell_id and b.x > a.x - 30 and b.x < a.x + 30 and (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) < 900),
    i as (select ta, tb, bin, {geo.disk_rect_sql("ax", "ay", "((bin+1)*10.0::double)", v.BBOX)} - case when bin > 0 then {geo.disk_rect_sql("ax", "ay", "greatest(bin*10.0::double, 1e-300)", v.BBOX)} else 0 end as area from p),
    s as (select ta, tb, bin, count(*) as n, sum(case when area > 1e-9 then 1.0 / area else 0 end) as s from i group by 1, 2, 3)
    select ks.a as type_a, ks.b as type_b, k.i::int as bin, coalesce(s.n, 0)::bigint as n_pairs, coalesce(s.s, 0) / (x.n::double * y.n / {AREA!r}) as g from ks cross join range(3) k(i) join cnt x on x.type_id = ks.a join cnt y on y.type_id = ks.b left join s on s.ta = ks.a and s.tb = ks.b and s.bin = k.i""",
    "g",
)
def pcf_matrix_edge_corrected(spark, sf):
    """The same as the binned matrix with rings cut by the window."""
    return pcf.pcf_matrix_binned(v.cells(spark, sf), v.BBOX, 30.0, 3, v.TYPES, edge_corrected=True)


@query("pcf_bin_membership", f"with {v.CELLS}, {_CROSS} select cell_id, bit_or(1::bigint << least(5, floor(sqrt(d2) / 10))::int) as bits from p group by 1")
def pcf_bin_membership(spark, sf):
    """Which rings of a cell hold a neighbour."""
    c = v.cells(spark, sf)
    return pcf.bin_membership(_of(c, 0), _of(c, 1), 60.0, 6)


@query(
    "pcf_matrix",
    f"with {PAIRS.format(r2=R * R)}, {COUNTS}, s as (select ta, tb, count(*) as m from pairs group by 1, 2) select x.type_id as type_a, y.type_id as type_b, coalesce(m, 0)::bigint as n_pairs, coalesce(m, 0) * {AREA!r} / (x.n::double * y.n * {math.pi * R * R!r}) as g from cnt x cross join cnt y left join s on s.ta = x.type_id and s.tb = y.type_id",
    "g",
)
def pcf_matrix(spark, sf):
    """Pair correlation of all pairs of types in one disk."""
    return pcf.pcf_matrix(v.cells(spark, sf), v.BBOX, R)


@query(
    "pcf_matrix_binned",
    f"with {PAIRS.format(r2=900.0)}, {COUNTS}, s as (select ta, tb, least(2, floor(sqrt(d2) / 10))::int as bin, count(*) as m from pairs group by 1, 2, 3), k as (select i::int as bin from range(3) r(i)) select x.type_id as type_a, y.type_id as type_b, k.bin, coalesce(m, 0)::bigint as n_pairs, coalesce(m, 0)::double / {_RING.replace('bin', 'k.bin')} * {AREA!r} / (x.n::double * y.n) as g from cnt x cross join cnt y cross join k left join s on s.ta = x.type_id and s.tb = y.type_id and s.bin = k.bin",
    "g",
)
def pcf_matrix_binned(spark, sf):
    """Pair correlation of all pairs of types in three rings."""
    return pcf.pcf_matrix_binned(v.cells(spark, sf), v.BBOX, 30.0, 3, v.TYPES)


_MARK = f"rho as (select count(*)::double / {AREA!r} as rho from b), m as (select a.cell_id, a.x, a.y, coalesce(count(p.d2), 0)::double / {math.pi * 3600!r} / (select rho from rho) as m from a left join p on p.cell_id = a.cell_id group by 1, 2, 3)"


@query("cross_marks", f"with {v.CELLS}, {_CROSS}, {_MARK} select * from m", "m")
def cross_marks(spark, sf):
    """Neighbours of another type against the expected number."""
    c = v.cells(spark, sf)
    return pcf.cross_marks(_of(c, 0), _of(c, 1), v.BBOX, 60.0)


@query("mark_to_m", f"with {v.CELLS}, {_CROSS}, {_MARK} select cell_id, case when m >= 5 then 1.0 when m > 1 then (m - 1) / 4 when m <= 0.2 then -1.0 else (1 - 1 / m) / 4 end::double as mapped from m", "mapped")
def mark_to_m(spark, sf):
    """Marks on the scale from -1 to 1."""
    m = cross_marks(spark, sf)
    return m.select("cell_id", pcf.mark_to_m(F.col("m"), 5.0).alias("mapped"))


_BX = f"least({math.ceil((X1 - X0) / 100)}, greatest(0, floor((x - {X0}) / 100)))::int"
_BY = f"least({math.ceil((Y1 - Y0) / 100)}, greatest(0, floor((y - {Y0}) / 100)))::int"
_NX = math.ceil((X1 - X0) / 100) + 1
_NB = _NX * (math.ceil((Y1 - Y0) / 100) + 1)


@query("bucket_grid", f"with {v.CELLS}, h as (select {_BY} * {_NX} + {_BX} as bucket, count(*) as n from cells group by 1), f as (select i::int as bucket, coalesce(n, 0)::bigint as n_points from range({_NB}) r(i) left join h on h.bucket = r.i) select bucket, n_points, coalesce(sum(n_points) over (order by bucket rows between unbounded preceding and 1 preceding), 0)::bigint as \"begin\" from f")
def bucket_grid(spark, sf):
    """Offsets of a uniform grid index."""
    return lattice.bucket_offsets(v.cells(spark, sf), 100.0, v.BBOX)


@query("grid_index", f"with {v.CELLS} select cell_id, {_BX} as bx, {_BY} as \"by\", {_BY} * {_NX} + {_BX} as bucket from cells")
def grid_index(spark, sf):
    """The bucket of every cell."""
    return lattice.bucketed(v.cells(spark, sf), 100.0, v.BBOX)[0].select("cell_id", "bx", "by", "bucket")


@query("lattice_for", f"with {v.CELLS} select min(x) as min_x, min(y) as min_y, max(x) as max_x, max(y) as max_y, (ceil((max(x) - min(x)) / 100) + 1)::bigint as nx, (ceil((max(y) - min(y)) / 100) + 1)::bigint as ny from cells")
def lattice_for(spark, sf):
    """Extent of the cells and its buckets."""
    return lattice.lattice_for(v.cells(spark, sf), 100.0)


@query("cell_counts", f"with {v.grid_sql()} select row, col, v::bigint as n from grid")
def cell_counts(spark, sf):
    """Cells in every tile of a raster."""
    return v.grid(spark, sf).select("row", "col", F.col("v").cast("long").alias("n"))


QUADRATS = f"{v.CELLS}, h as (select type_id, least({math.ceil((Y1 - Y0) / 100) - 1}, greatest(0, floor((y - {Y0}) / 100)))::int * {math.ceil((X1 - X0) / 100)} + least({math.ceil((X1 - X0) / 100) - 1}, greatest(0, floor((x - {X0}) / 100)))::int as quadrat, count(*) as n from cells group by 1, 2), q as (select t.i::int as type_id, s.i::int as quadrat, coalesce(n, 0)::bigint as n from range(5) t(i) cross join range({math.ceil((X1 - X0) / 100) * math.ceil((Y1 - Y0) / 100)}) s(i) left join h on h.type_id = t.i and h.quadrat = s.i)"


@query("quadrat_counts", f"with {QUADRATS} select * from q")
def quadrat_counts(spark, sf):
    """Cells of every type in every quadrat."""
    return lattice.quadrats(v.cells(spark, sf), v.BBOX, 100.0, v.TYPES)


@query("quadrat_pearson", f"with {QUADRATS} select a.type_id as type_a, b.type_id as type_b, corr(a.n, b.n) as r from q a join q b on a.quadrat = b.quadrat group by 1, 2", "r")
def quadrat_pearson(spark, sf):
    """Correlation of the counts of two types over quadrats."""
    from quadrille.operators.inference import row_correlation

    return row_correlation(quadrat_counts(spark, sf), "type_id", "quadrat", "n")


_NN = f"nn as (select a.cell_id, sqrt(min((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y))) as d from cells a join cells b on a.cell_id <> b.cell_id group by 1)"


@query("nn_distance", f"with {v.CELLS}, {_NN} select * from nn", "d")
def nn_distance(spark, sf):
    """Distance to the nearest other cell."""
    c = v.cells(spark, sf)
    return k_nearest(c, c, 1, 10.0, "cell_id", "cell_id", exclude_self=True).select("cell_id", "d")


@query("nn_distance_indexed", f"with {v.CELLS}, {_NN} select cell_id, case when d <= 20 then d else 'infinity'::double end as d from nn", "d")
def nn_distance_indexed(spark, sf):
    """The same as far as 20, else infinite."""
    return neighbours.nearest_within(v.cells(spark, sf), 20.0)


@query("kth_nn_distance", f"with {v.CELLS}, m as (select a.cell_id, min((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y), 4) as ds from cells a join cells b on a.cell_id <> b.cell_id group by 1) select cell_id, sqrt(ds[4]) as d from m", "d")
def kth_nn_distance(spark, sf):
    """Distance to the fourth nearest other cell."""
    c = v.cells(spark, sf)
    return k_nearest(c, c, 4, 20.0, "cell_id", "cell_id", exclude_self=True).where("rank = 4").select("cell_id", "d")


_LOTS = f"lots as (select i as site, {X0} + (((i * 7919) % 10007) + 0.5::double) / 10007 * {X1 - X0} as x, {Y0} + (((i * 104729) % 10009) + 0.5::double) / 10009 * {Y1 - Y0} as y from range(1024) r(i))"


def _lots(spark):
    i = F.col("id")
    spot = lambda low, span, m, p: F.lit(low) + (F.pmod(i * m, F.lit(p)) + 0.5) / p * span
    return spark.range(1024).select(i.alias("site"), spot(X0, X1 - X0, 7919, 10007).alias("x"), spot(Y0, Y1 - Y0, 104729, 10009).alias("y"))


@query("empty_space", f"with {v.CELLS}, {_LOTS} select site, sqrt(min((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y))) as d from lots a cross join cells b group by 1", "d")
def empty_space(spark, sf):
    """Distance from 1024 sites to the nearest cell."""
    return k_nearest(_lots(spark), v.cells(spark, sf), 1, 40.0, "site", "cell_id").select("site", "d")


@query(
    "anni",
    f"with {v.CELLS}, {_NN}, s as (select avg(d) as obs, count(*)::double as n from nn) select obs as mean_distance, 0.5 / sqrt(n / {AREA!r}) as expected, obs / (0.5 / sqrt(n / {AREA!r})) as anni, (obs - 0.5 / sqrt(n / {AREA!r})) / (0.26136 / sqrt(n * n / {AREA!r})) as z, case when (obs - 0.5 / sqrt(n / {AREA!r})) / (0.26136 / sqrt(n * n / {AREA!r})) < -1.96 then 'clustered' when (obs - 0.5 / sqrt(n / {AREA!r})) / (0.26136 / sqrt(n * n / {AREA!r})) > 1.96 then 'dispersed' else 'random' end as interpretation from s",
    "mean_distance expected anni z",
)
def anni(spark, sf):
    """Average nearest-neighbour index."""
    return neighbours.anni(nn_distance(spark, sf), AREA)


def _polygon():
    return [[(1200.0, 500.0), (3300.0, 800.0), (2900.0, 4500.0), (1500.0, 4200.0)], [(2000.0, 2000.0), (2400.0, 2000.0), (2400.0, 2600.0), (2000.0, 2600.0)]]


def _crossings_sql():
    out = []
    for ring in _polygon():
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if ay != by:
                out.append(f"(case when ({ay} > y) <> ({by} > y) and x < {bx - ax} * (y - {ay}) / {by - ay} + {ax} then 1 else 0 end)")
    return " + ".join(out)


@query("domain_contains_rect", f"with {v.CELLS} select cell_id, x between 1500 and 2500 and y between 1000 and 3000 as inside from cells")
def domain_contains_rect(spark, sf):
    """Cells in a closed rectangle."""
    return v.cells(spark, sf).select("cell_id", geo.in_box(F.col("x"), F.col("y"), (1500.0, 1000.0, 2500.0, 3000.0)).alias("inside"))


@query("domain_contains_polygon", f"with {v.CELLS} select cell_id, ({_crossings_sql()}) % 2 = 1 as inside from cells")
def domain_contains_polygon(spark, sf):
    """Cells in a polygon with a hole."""
    geo.check_simple(_polygon())
    return v.cells(spark, sf).select("cell_id", geo.in_polygon(F.col("x"), F.col("y"), _polygon()).alias("inside"))


@query("domain_contains_mask", f"with {v.grid_sql()}, s as (select cell_id, 63 - least(63, greatest(0, floor((y - {Y0}) / {Y1 - Y0} * 64)))::int as row, least(63, greatest(0, floor((x - {X0}) / {X1 - X0} * 64)))::int as col from cells) select cell_id, v > 3 as inside from s join grid using (row, col)")
def domain_contains_mask(spark, sf):
    """Cells in the pixels of a mask."""
    c = v.cells(spark, sf).withColumns({"col": lattice.share_slot("x", X0, X1, 64), "row": 63 - lattice.share_slot("y", Y0, Y1, 64)})
    mask = v.grid(spark, sf).where("v > 3").select("row", "col", F.lit(True).alias("inside"))
    return c.join(F.broadcast(mask), ["row", "col"], "left").select("cell_id", F.coalesce("inside", F.lit(False)).alias("inside"))


@query("polygon_area", f"select {sum(abs(geo.ring_area(r)) * s for r, s in zip(_polygon(), (1, -1), strict=True))!r}::double as area", "area")
def polygon_area(spark, sf):
    """Area of a polygon with a hole."""
    rows = [(r, i, x, y) for r, ring in enumerate(_polygon()) for i, (x, y) in enumerate(ring)]
    return neighbours.polygon_area(spark.createDataFrame(rows, "ring int, i int, x double, y double"))


@query("domain_area", f"with {v.grid_sql()} select count(*) filter (where v > 3) * {(X1 - X0) / 64 * (Y1 - Y0) / 64!r} as area from grid", "area")
def domain_area(spark, sf):
    """Area of the pixels of a mask."""
    return v.grid(spark, sf).agg((F.count_if(F.col("v") > 3) * ((X1 - X0) / 64 * (Y1 - Y0) / 64)).alias("area"))


_DISK = geo.disk_rect_sql("x", "y", "150.0::double", v.BBOX)
_DISK2 = geo.disk_rect_sql("x", "y", "100.0::double", v.BBOX)


@query("disk_rect_area", f"with {v.CELLS} select cell_id, {_DISK} as area from cells", "area")
def disk_rect_area(spark, sf):
    """Area of a disk about each cell within the window."""
    return v.cells(spark, sf).select("cell_id", geo.disk_rect_area(F.col("x"), F.col("y"), F.lit(150.0), v.BBOX).alias("area"))


@query("annulus_rect_area", f"with {v.CELLS} select cell_id, {_DISK} - {_DISK2} as area from cells", "area")
def annulus_rect_area(spark, sf):
    """Area of a ring about each cell within the window."""
    return v.cells(spark, sf).select("cell_id", geo.annulus_rect_area(F.col("x"), F.col("y"), F.lit(100.0), F.lit(150.0), v.BBOX).alias("area"))


@query("annulus_areas", f"with {v.CELLS} select cell_id, k.i::int as bin, {geo.disk_rect_sql('x', 'y', '((k.i+1)*50.0::double)', v.BBOX)} - case when k.i > 0 then {geo.disk_rect_sql('x', 'y', 'greatest(k.i*50.0::double, 1e-300)', v.BBOX)} else 0 end as area from cells cross join range(3) k(i)", "area", 5)
def annulus_areas(spark, sf):
    """Areas of all rings about each cell."""
    return v.cells(spark, sf).select("cell_id", F.posexplode(geo.annulus_areas(F.col("x"), F.col("y"), 150.0, 3, v.BBOX)).alias("bin", "area"))


@query("corner_area", f"with {v.CELLS} select cell_id, {geo.corner_sql('50.0::double', '(x - 1096)', '(y / 10)')} as area from cells", "area")
def corner_area(spark, sf):
    """Area of a quarter disk within a corner."""
    return v.cells(spark, sf).select("cell_id", geo.corner_area(F.lit(50.0), F.col("x") - 1096, F.col("y") / 10).alias("area"))
