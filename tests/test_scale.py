"""Work that follows the input: pairs that are listed, rows of one task, runs on dense and on thin tables."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille import plans
from quadrille.operators import envelopes, neighbours, pcf, range_join, vectors
from quadrille.sources import matrices

POINTS = "cell_id long, x double, y double"


def _brute(q, p, k):
    """{query id: [(id, distance)]} of other points, ties to the lower id."""
    out = {}
    for i, x, y in q:
        near = sorted((np.hypot(x - u, y - w), j) for j, u, w in p if j != i)[:k]
        out[i] = [(j, d) for d, j in near]
    return out


@pytest.fixture
def crowd():
    rng = np.random.Generator(np.random.PCG64(3))
    xy = np.concatenate([rng.uniform(0, 100, (600, 2)), rng.normal(40, 0.01, (900, 2)), np.repeat(rng.uniform(0, 100, (3, 2)), 60, 0), [[900.0, -400.0]]])
    return [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)]


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_lists_few_pairs(spark, monkeypatch, crowd, k):
    """Tiles that are split, coincident points, outliers; the pairs of the radius search stay few whatever the first radius."""
    listed, search = [], range_join.within_radius

    def counted(*a, **kw):
        out = search(*a, **kw)
        listed.append(out.count())
        return out

    monkeypatch.setattr(range_join, "within_radius", counted)
    monkeypatch.setattr(range_join, "TILE_POINTS", 100, raising=False)
    monkeypatch.setattr(range_join, "TILE_MOST", 250, raising=False)
    c = spark.createDataFrame([*crowd, (9999, None, 1.0)], POINTS)
    got = {}
    for r in range_join.k_nearest(c, c, k, 50.0, "cell_id", "cell_id", exclude_self=True).orderBy("cell_id", "rank").collect():
        got.setdefault(r.cell_id, []).append((r.neighbour, pytest.approx(r.d)))
    assert got == _brute(crowd, crowd, k)
    assert sum(listed) < 30 * len(crowd)
    far = [(10_000 + i, float(x), float(y)) for i, (x, y) in enumerate([(-5000, 7), (50, 50), (101, 99), (900, -399)])]
    q = spark.createDataFrame(far, POINTS)
    got = {}
    for r in range_join.k_nearest(q, c, k, 50.0, "cell_id", "cell_id").orderBy("cell_id", "rank").collect():
        got.setdefault(r.cell_id, []).append((r.neighbour, pytest.approx(r.d)))
    assert got == _brute(far, crowd, k)


def test_nearest_within_joins_nothing(spark, crowd):
    """No join of the points with their distances, so nothing of their size is broadcast through the driver."""
    c = spark.createDataFrame(crowd, POINTS)
    out = neighbours.nearest_within(c, 2.0)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {i: near[0][1] if near[0][1] <= 2.0 else np.inf for i, near in _brute(crowd, crowd, 1).items()}
    assert {r.cell_id: pytest.approx(r.d) for r in out.collect()} == want


@pytest.mark.parametrize("name", ["force_separate", "force_spring"])
def test_forces_of_close_bodies(spark, tmp_path, name):
    """Bodies nearer than 0.001 count as in the SQL; those at one place have no direction."""
    rng = np.random.Generator(np.random.PCG64(5))
    v = rng.normal(0, 0.05, (12, 64))
    v[1] = v[0]
    v[1, 0] += 3e-5  # 0.0003 apart, as positions are ten times the vectors
    v[3, :3] = v[2, :3]
    rows = [(i, x.astype(np.float32).tolist(), 0) for i, x in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.execute(f"select id, fx, fy, fz from ({plans.oracle_sql()[name]}) q").fetchall()}
    got = {r.id: (r.fx, r.fy, r.fz) for r in plans.queries()[name](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], abs=1e-9, nan_ok=True) for i in want)
    assert np.isnan(got[2]).all() and np.isnan(got[3]).all() and not np.isnan(got[0]).any()


def test_thin_genes(spark, tmp_path):
    """A table whose bins of side 20 hold too few molecules: wider bins instead of an error."""
    rng = np.random.Generator(np.random.PCG64(6))
    n = 6000
    rows = [(int(x), int(y), int(c), float(q), "N") for x, y, c, q in zip(rng.integers(0, 4000, n), rng.integers(0, 4000, n), rng.integers(1, 8, n), rng.integers(1, 51, n), strict=True)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = plans.queries()["gene_embedding"](spark, str(tmp_path)).collect()
    assert len(found) == 21 and sum(r.molecules for r in found) == n
    assert sorted(r.code for r in plans.queries()["gene_modules"](spark, str(tmp_path)).collect()) == sorted(r.code for r in found)


def test_labels_without_a_sort_of_all(spark):
    """The points at given ranks of each order, and as many labels of each kind as before; no pair is stored."""
    n = 3000
    c = spark.range(n).select(F.col("id").alias("cell_id"), (F.pmod(F.xxhash64("id"), F.lit(1000)) * 1.0).alias("x"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) * 1.0).alias("y"), F.pmod(F.col("id"), F.lit(3)).cast("int").alias("channel"))
    sims = spark.range(1, 4).select(F.col("id").cast("int").alias("sim"))
    got = envelopes.cuts(c, sims, [1, 1000, 3000], "cell_id", 7)
    for s in (1, 2, 3):
        order = [(r.h, r.cell_id) for r in c.select("cell_id", F.xxhash64("cell_id", F.lit(s), F.lit(7)).alias("h")).orderBy("h", "cell_id").collect()]
        assert got[s] == [order[0], order[999], order[2999]]
    box = (0.0, 0.0, 1000.0, 1000.0)
    a, b = c.where("channel = 0"), c.where("channel = 1")
    curves = envelopes.relabelled_pcf(a, b, box, 30.0, 3, 70)  # more than one pass holds
    want = [r.g for r in pcf.cross_pcf(a, b, box, 30.0, 3).orderBy("bin").collect()]
    assert [r.v for r in curves.where("sim = 0").orderBy("r").collect()] == pytest.approx(want)
    every = curves.where("sim > 0").groupBy("r").agg(F.avg("v").alias("m"), F.stddev("v").alias("sd")).collect()
    assert curves.count() == 71 * 3 and all(abs(r.m - 1) < 0.1 and r.sd > 0 for r in every)
    plan = envelopes.spectra(c, box, 4, 4, 300.0, 2, 3)
    assert plan.count() == 12 and plan.where("sim = 0").agg(F.sum("v")).first()[0] == pytest.approx(1.0)


def test_vectors_by_blocks(spark):
    """Neighbours and ranks over several blocks as by brute force, ties included; values that are floats are sent as floats."""
    rng = np.random.Generator(np.random.PCG64(8))
    for x in (rng.integers(-2, 3, (700, 4)).astype(float), rng.normal(size=(700, 4))):
        df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
        d = ((x[:, None] - x[None]) ** 2).sum(2)
        np.fill_diagonal(d, np.inf)
        order = np.lexsort((np.broadcast_to(np.arange(700), d.shape), d), axis=1)
        near = vectors.knn(df, 5, block_rows=300)
        got = near.orderBy("i", "rank").toPandas()
        assert (got["j"].to_numpy().reshape(700, 5) == order[:, :5]).all()
        place = np.argsort(order, axis=1) + 1
        asked = near.select("i", (F.pmod(F.col("j") * 7 + F.col("i"), F.lit(700))).alias("j")).where("i <> j").distinct()
        ranks = vectors.ranks_of(df, asked, block_rows=300).toPandas()
        assert len(ranks) == asked.count() and (ranks["rank"].to_numpy() == place[ranks["i"], ranks["j"]]).all()
        assert ("as array<float>" in near._jdf.queryExecution().optimizedPlan().toString()) == (x == x.round()).all()


def test_own_radius(spark):
    """Pairs by the wider end of each; one wide point leaves the others their own lattice."""
    rng = np.random.Generator(np.random.PCG64(9))
    xy, w = rng.uniform(0, 30, (400, 2)), rng.choice([0.0, 0.25, 0.5, 1.1, 9.0], 400, p=[0.1, 0.4, 0.3, 0.19, 0.01])
    xy[1], w[:2] = xy[0], 0.0
    c = spark.createDataFrame([(i, float(x), float(y), float(r)) for i, ((x, y), r) in enumerate(zip(xy, w, strict=True))], "id long, x double, y double, w double")
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    want = {(i, j) for i, j in np.argwhere(d <= 3 * np.maximum(w[:, None], w[None])).tolist() if i != j}
    rows = [(r.i, r.j) for r in range_join.within_own_radius(c, "w", 3.0).collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_about_without_the_graph(spark, sf, monkeypatch):
    """What is known of a graph doesn't wait for its edges."""
    monkeypatch.setattr(matrices, "write_graph", None)
    assert {tuple(r) for r in plans.queries()["sink_uns"](spark, sf).collect()} == {("radius", "20"), ("method", "radius")}


@pytest.mark.parametrize("name", ["contact_edges", "fuzzy_adjacency"])
def test_pairs_are_dealt_out(spark, sf, name):
    """The pairs of a table whose file is small are not all listed by the few tasks that read it."""
    plan = plans.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
