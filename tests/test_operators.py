"""Small cases with known answers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions import geometry, scales
from quadrille.operators import contact, density, grids, inference, lattice, pcf, topology, vectors
from quadrille.operators.range_join import k_nearest, within_radius
from quadrille.plans import registry
from quadrille.sources import cells_csv, matrices
from quadrille.streaming import ticks


def _cells(spark, rows):
    return spark.createDataFrame(rows, "cell_id long, x double, y double, type_id int")


def test_radius_is_open(spark):
    c = _cells(spark, [(1, 0.0, 0.0, 0), (2, 10.0, 0.0, 0), (3, 0.0, 9.999, 1)])
    near = within_radius(c, c, 10.0).where("a_cell_id <> b_cell_id")
    assert sorted((r.a_cell_id, r.b_cell_id) for r in near.collect()) == [(1, 3), (3, 1)]
    assert within_radius(c, c, 10.0, closed=True).where("a_cell_id < b_cell_id").count() == 2
    assert within_radius(c, c, 10.0, closed=True, salt=3).where("a_cell_id < b_cell_id").count() == 2


def test_contacts_count_the_diagonal_once(spark):
    c = _cells(spark, [(1, 0.0, 0.0, 0), (2, 1.0, 0.0, 0), (3, 0.0, 0.0, 1), (4, 500.0, 500.0, 2)])
    got = {(r.type_a, r.type_b): r for r in contact.contact_network(c, 5.0, 3).collect()}
    assert (got[0, 0].edges, got[0, 0].contacts, got[0, 1].edges, got[1, 0].edges, got[1, 0].contacts) == (1, 2, 2, 2, 1)
    assert math.isnan(got[2, 0].network_pct) and got[2, 2].n_a == 1
    assert contact.contact_network(c.limit(0), 5.0, 3).count() == 9


def test_disks_in_the_window():
    x = lambda v: F.lit(float(v))
    assert geometry.ring_area([(0, 0), (2, 0), (2, 2), (0, 2)]) == 4
    assert geometry.inverse((1, 0, 0, 2, 0, 0)) is None
    with pytest.raises(ValueError):
        geometry.check_simple([[(0, 0), (2, 2), (2, 0), (0, 2)]])
    assert x(1) is not None


def test_disk_area_against_counting(spark):
    box = (0.0, 0.0, 10.0, 6.0)
    points = [(0.0, 0.0, 3.0), (5.0, 3.0, 2.0), (9.0, 5.5, 4.0), (12.0, 3.0, 4.0), (5.0, 3.0, 40.0)]
    df = spark.createDataFrame(points, "x double, y double, r double")
    got = [r.a for r in df.select(geometry.disk_rect_area(F.col("x"), F.col("y"), F.col("r"), box).alias("a")).collect()]
    gx, gy = np.meshgrid((np.arange(2000) + 0.5) / 200, (np.arange(1200) + 0.5) / 200)
    for (x, y, r), a in zip(points, got, strict=True):
        assert a == pytest.approx(((gx - x) ** 2 + (gy - y) ** 2 < r * r).sum() / 40_000, abs=0.02)


def test_independent_points_have_g_of_one(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(y), i % 2) for i, (x, y) in enumerate(rng.uniform(0, 1000, (6000, 2)))]
    g = [r.g for r in pcf.pcf_matrix_binned(_cells(spark, rows), (0.0, 0.0, 1000.0, 1000.0), 60.0, 3, 2, edge_corrected=True).collect()]
    assert np.allclose(g, 1, atol=0.06)


def test_nearest_goes_as_far_as_needed(spark):
    c = _cells(spark, [(1, 0.0, 0.0, 0), (2, 3.0, 4.0, 0), (3, 9000.0, 0.0, 0)])
    got = {r.cell_id: (r.neighbour, r.d) for r in k_nearest(c, c, 1, 1.0, "cell_id", "cell_id", exclude_self=True).collect()}
    assert got[1] == (2, 5.0) and got[2] == (1, 5.0) and got[3][0] == 2
    assert k_nearest(c.where("cell_id = 1"), c.where("cell_id = 1"), 1, 1.0, "cell_id", "cell_id", exclude_self=True).count() == 0


def test_scan_over_ranges(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(500)], "i long, v long")
    got = [r.scan for r in lattice.exclusive_scan(df, "i", "v", 7).orderBy("i").collect()]
    assert got == np.concatenate([[0], np.cumsum([i % 3 for i in range(499)])]).tolist()


def test_scan_of_rows_with_other_columns(spark):
    """More rows than the sample of a range partitioning holds, so that a second one would have other bounds."""
    df = spark.range(400_000, numPartitions=4).select(F.xxhash64("id").alias("i"), (F.col("id") % 3).alias("v"), F.col("id").cast("string").alias("s"))
    total, bad, _ = lattice.exclusive_scan(df, "i", "v", 16).selectExpr("total", "scan", "s", "sum(v) over (order by i) - v as want").agg(F.max("total"), F.count_if(F.expr("scan <> want")), F.max("s")).first()
    assert (total, bad) == (399_999, 0)


def test_long_series_cross_ranges(spark):
    rows = [(k, t, float((t * 7 + len(k or "")) % 11)) for k, n in (("hot", 900), ("b", 40), (None, 60)) for t in range(n)] + [("gap", t, None if t == 200 else 1.0) for t in range(400)]
    df = spark.createDataFrame(rows, "key string, t long, x double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {(r.key, r.t): r.y for r in ticks.one_pole(df, 40.0).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows)
    y: dict = {}
    for k, t, x in rows:
        y[k] = x if t == 0 else None if x is None or y[k] is None else y[k] + (1 - math.exp(-1 / 40)) * (x - y[k])
        assert got[k, t] is None if y[k] is None else abs(got[k, t] - y[k]) < 1e-9, (k, t)


def test_partial_correlations():
    r = np.array([[1, 0.5, np.nan], [0.5, 1, np.nan], [np.nan, np.nan, np.nan]])
    p = inference.partial_correlation(r)
    assert p[0, 1] == pytest.approx(0.5) and np.isnan(p[2]).all()
    assert np.isnan(inference.partial_correlation(np.ones((2, 2)))).all()


def test_rates_skip_what_is_not_a_number(spark):
    t = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, float("nan"))], "id int, p double")
    q = {r.id: r.q for r in inference.benjamini_hochberg(t, ["id"]).collect()}
    assert q[1] == pytest.approx(0.03) and q[2] == pytest.approx(0.04) and q[3] == pytest.approx(0.04) and math.isnan(q[4])


def test_envelope_needs_curves(spark):
    with pytest.raises(ValueError):
        inference.rank_envelope(spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0)], "sim int, r int, v double"), 0.05)


def test_wavelets_come_back(spark):
    rows = [(g, r, c, float((r * 7 + c * 13 + g) % 11)) for g in (1, 2) for r in range(9) for c in range(14)]
    g = spark.createDataFrame(rows, "grid_id int, row int, col int, v double")
    for kernel in ("5/3", "9/7"):
        back = grids.wavelet(grids.wavelet(g, 3, kernel), 3, kernel, back=True)
        assert {(r.grid_id, r.row, r.col): round(r.v, 6) for r in back.collect()} == {(a, b, c): v for a, b, c, v in rows}


def test_flat_raster_has_no_hot_spots(spark):
    g = spark.createDataFrame([(r, c, 2.0) for r in range(8) for c in range(8)], "row int, col int, v double")
    assert {r.z for r in grids.getis_ord(g).collect()} == {0.0}
    assert grids.flood(g.limit(0), 0, 0).count() == 0


def test_distance_transform_without_background(spark):
    g = spark.createDataFrame([(r, c, 1.0) for r in range(3) for c in range(3)], "row int, col int, v double")
    assert {r.d for r in grids.distance_transform(g).collect()} == {float("inf")}
    assert {(r.row, r.col): r.d for r in grids.distance_transform(g, border=True).collect()}[1, 1] == 2.0


def test_rips_of_a_square():
    d = {(0, 1): 1.0, (1, 2): 1.0, (2, 3): 1.0, (0, 3): 1.0, (0, 2): 2**0.5, (1, 3): 2**0.5}
    s = [(0.0, 0, (k,)) for k in range(4)] + [(v, 1, e) for e, v in d.items()] + [(2**0.5, 2, t) for t in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))]
    got = topology.reduce_columns(s)
    assert (0, 0.0, math.inf) in got and (1, 1.0, 2**0.5) in got and sum(x[0] == 0 for x in got) == 4


def test_exact_and_approximate_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8)) + rng.integers(0, 5, (400, 1)) * 4
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    exact = vectors.knn(df, 5, block_rows=150)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = {(i, k + 1): int(j) for i in range(400) for k, j in enumerate(np.argsort(d[i], kind="stable")[:5])}
    assert {(r.i, r.rank): r.j for r in exact.collect()} == want
    assert vectors.recall(vectors.knn_approx(df, 5), exact).first()["recall"] > 0.9


def test_recall_of_approximate_neighbours_of_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id as id", "cast(embedding as array<double>) as v")
    assert vectors.recall(vectors.knn_approx(df, 10), vectors.knn(df, 10)).first()["recall"] >= 0.9


def test_pca_against_numpy(spark):
    x = np.random.default_rng(2).normal(size=(300, 6)) * np.arange(1, 7)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    scores, rows, explained = vectors.pca(df, 3)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1][:3]
    assert np.allclose(explained, values)
    got = np.array([r.scores for r in scores.orderBy("id").collect()])
    assert np.allclose(got, (x - x.mean(0)) @ rows.T)


def test_emeans_finds_blobs(spark):
    rng = np.random.default_rng(1)
    centres = np.array([[0, 0], [20, 0], [0, 20], [20, 20]])
    x = np.concatenate([rng.normal(c, 0.5, (100, 2)) for c in centres])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    labels, c = vectors.emeans(df, 4, epochs=6, seed=1)
    assert labels.count() == 400 and len(c) == 4


def test_csv(spark, tmp_path):
    p = tmp_path / "cells.csv"
    p.write_text('x,y,cell_type\n1,2,"a, ""b"""\n\nbad,3,c\n4,5,\n6,7,c\n')
    rows = cells_csv.scan(spark, str(p))
    found = [r.asDict() for r in cells_csv.profile(rows).orderBy("place").collect()]
    assert cells_csv.suggested(found) == {"x": "x", "y": "y", "type": "cell_type"} or found[0]["numeric_fraction"] == 0.75
    held = rows.withColumn("i", F.monotonically_increasing_id())
    assert sorted(r.type for r in cells_csv.grouped(held, "x", "y", "cell_type", "i").collect()) == ['a, "b"', "c"]


def test_sinks_refuse(spark, tmp_path):
    e = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "cell long, v array<double>")
    with pytest.raises(ValueError):
        matrices.write_embedding(e, str(tmp_path / "a"), 3)
    matrices.write_embedding(e, str(tmp_path / "a"), 2)
    with pytest.raises(Exception, match="exists"):
        matrices.write_embedding(e, str(tmp_path / "a"), 2)
    matrices.write_embedding(e, str(tmp_path / "a"), 2, force=True)
    g = spark.createDataFrame([(0, 5, 1.0)], "row long, col long, weight double")
    with pytest.raises(ValueError):
        matrices.write_graph(g, str(tmp_path / "g"), 2)
    matrices.write_graph(g, str(tmp_path / "g"), 6, about={"k": 3})
    assert spark.read.parquet(str(tmp_path / "g")).count() == 1


def test_registry_refuses_a_second_name():
    registry.query("only_in_this_test")(lambda spark, sf: None)
    try:
        with pytest.raises(ValueError):
            registry.query("only_in_this_test")(lambda spark, sf: None)
        with pytest.raises(KeyError):
            registry.get("no_such_query")
    finally:
        registry._entries.pop("only_in_this_test")


def test_stream_equals_batch(spark, tmp_path, sf):
    from quadrille import views

    s = views.series(spark, sf).select("key", "t", "x")
    s.write.parquet(str(tmp_path / "in"))
    stream = ticks.one_pole_stream(spark.readStream.schema(s.schema).parquet(str(tmp_path / "in")), 4.0)
    q = stream.writeStream.format("memory").queryName("smoothed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.key, r.t): round(r.y, 6) for r in spark.table("smoothed").collect()}
    want = {(r.key, r.t): round(r.y, 6) for r in ticks.one_pole(s, 4.0).collect()}
    assert got == want and len(got) == s.count()


def test_kernels_have_unit_mass():
    n = 2001
    g = np.linspace(-30, 30, n)
    d2 = g[:, None] ** 2 + g[None] ** 2
    for degree in (0, 1, 2, 3):
        k = np.where(d2 < 900, (degree + 1) / (math.pi * 900) * (1 - d2 / 900) ** degree, 0)
        h = (g[1] - g[0]) ** 2
        assert k.sum() * h == pytest.approx(1, abs=2e-3)
        assert (k * d2).sum() * h == pytest.approx(scales.moment2(30.0, degree), rel=5e-3)
        assert (k * k).sum() * h == pytest.approx(scales.roughness(30.0, degree), rel=5e-3)


def test_weights_must_be_positive(spark):
    with pytest.raises(ValueError):
        density.transcript_channels(spark.range(1), {1: ("a", 0.0)}, (0.0, 0.0, 1.0, 1.0), 0.0, 0.0)


def test_nothing_imports_the_text_operators():
    from pathlib import Path

    top = Path(__file__).resolve().parents[1] / "quadrille"
    for p in top.rglob("*.py"):
        if p.parent.name != "llm":
            assert "quadrille.llm" not in p.read_text()
