"""Generators against their truths, nulls, trees, populations, planning: small cases with known answers."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quadrille.functions import forces, geometry, planning, scales, spectra, trees
from quadrille.operators import density, envelopes, generators, grids, inference, modules, pcf, populations, scoring, vectors, wand

BOX = (0.0, 0.0, 1000.0, 1000.0)


def test_cohesion_and_steps_by_hand(spark):
    b = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0), (2, 0.0, 2.0, 0.0), (3, 50.0, 0.0, 0.0)], "id long, px double, py double, pz double")
    got = {r.id: (r.fx, r.fy, r.fz) for r in forces.gathered(b, 5.0, "cohere", 1.0).collect()}
    assert got[0] == pytest.approx((0.012, 0.012, 0.0)) and got[3] == (0.0, 0.0, 0.0)
    still = {f"{k}{c}": F.lit(0.0) for k in "vaow" for c in "xyz"}
    one = forces.integrate(b.where("id = 0").withColumns(still | {"fx": F.lit(1.0), "fy": F.lit(0.0), "fz": F.lit(0.0)})).first()
    assert one.ax == pytest.approx(0.05) and one.vx == pytest.approx(0.05 * 0.2 * 0.96) and one.px == pytest.approx(0.05 * 0.2 * 0.96 * 0.2)
    assert one.wy == pytest.approx(0.3 * 0.2 * 0.9)  # from facing z towards x
    far = forces.integrate(b.where("id = 3").withColumns(still | {"fx": F.lit(0.0), "fy": F.lit(0.0), "fz": F.lit(0.0)})).first()
    assert far.px == pytest.approx(40.0)


def test_patterns_have_their_pair_correlation(spark):
    def g(key, a, b, **options):
        c = generators.point_pattern(spark, key, n=2500.0, seed=3, **options).cache()
        assert c.count() == c.select("cell_id").distinct().count()
        return [r.g for r in pcf.pcf_matrix_binned(c, BOX, 30.0, 3, 2, edge_corrected=True).where(f"type_a = {a} and type_b = {b}").orderBy("bin").collect()]

    assert g("csr", 0, 1) == pytest.approx([1, 1, 1], abs=0.2)
    truth = [1 + math.exp(-(r**2) / (2 * 25**2)) / (2 * math.pi * 25**2 * 2500 / 1e6) for r in (7, 16, 25.5)]
    assert g("colocalised", 0, 1) == pytest.approx(truth, abs=0.15)
    assert g("segregated", 0, 1) == [0, 0, 0]
    assert g("independent_clustered", 0, 1) == pytest.approx([1, 1, 1], abs=0.45) and min(g("thomas", 0, 1)) > 1.5
    hard = pcf.cross_pcf(*[generators.point_pattern(spark, "hardcore", seed=1, core=10.0)] * 2, BOX, 10.0, 1).first()
    assert hard.n_pairs == generators.point_pattern(spark, "hardcore", seed=1, core=10.0).count()  # each with itself
    with pytest.raises(KeyError):
        generators.point_pattern(spark, "none")


def test_manifolds(spark):
    for key in generators.MANIFOLDS:
        x = generators.manifold(spark, key, 300)
        assert x.count() == 300 and x.where(F.exists("v", lambda c: c.isNull() | F.isnan(c))).count() == 0
    r = generators.manifold(spark, "sphere", 300).select(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)).alias("r")).collect()
    assert {round(x.r, 9) for x in r} == {1.0}
    assert len(generators.expressed(generators.manifold(spark, "blobs", 50), 3, 4).first().v) == 12


def test_envelopes_of_pair_correlations(spark):
    c = generators.point_pattern(spark, "colocalised", n=300.0, seed=5).cache()
    a, b = c.where("type_id = 0"), c.where("type_id = 1")
    want = [r.g for r in pcf.cross_pcf(a, b, BOX, 60.0, 3, True).orderBy("bin").collect()]
    for curves in (envelopes.shifted_pcf(a, b, BOX, 60.0, 3, 19, edge_corrected=True), envelopes.relabelled_pcf(a, b, BOX, 60.0, 3, 19, edge_corrected=True)):
        assert [r.v for r in curves.where("sim = 0").orderBy("r").collect()] == pytest.approx(want)
        assert curves.count() == 60
    out = inference.rank_envelope(envelopes.shifted_pcf(a, b, BOX, 60.0, 3, 19), 0.1).orderBy("r").collect()
    assert out[0].exits and out[0].observed > out[0].hi and out[0].p == pytest.approx(0.05)
    assert inference.excursions(inference.rank_envelope(envelopes.shifted_pcf(a, b, BOX, 60.0, 3, 19), 0.1)).where("above").count() >= 1
    with pytest.raises(ValueError):
        envelopes.relabelled_pcf(a, b, BOX, 60.0, 3, 19, most_pairs=1)


def test_swaps_keep_margins():
    rng = np.random.default_rng(0)
    m = rng.poisson(2.0, (4, 30))
    table = m.tolist()
    assert inference.swap_chain(table, 500, random.Random(1)) == 500
    got = np.array(table)
    assert (got.sum(0) == m.sum(0)).all() and (got.sum(1) == m.sum(1)).all() and (got >= 0).all() and (got != m).any()
    assert not inference.swap([[1, 0], [0, 0]], random.Random(1)) and not inference.swap([[3, 3]], random.Random(1))
    dealt = inference.dealt_table(m.sum(0), m.sum(1), np.random.Generator(np.random.PCG64(2)))
    assert (dealt.sum(0) == m.sum(0)).all() and (dealt.sum(1) == m.sum(1)).all()


def test_nulls_find_planted_association(spark):
    rng = np.random.default_rng(4)
    base = rng.poisson(3, 80)
    table = np.stack([base, base + rng.poisson(1, 80), rng.poisson(3, 80)])
    counts = spark.createDataFrame([(t, q, int(table[t, q])) for t in range(3) for q in range(80)], "type_id int, quadrat int, n long")
    for null in ("label", "swap"):
        got = {(r.type_a, r.type_b): r for r in inference.quadrat_null(counts, "type_id", "quadrat", "n", 3, 99, null=null, burn_in=500, between=50).collect()}
        assert got[0, 1].p == 0.01 and got[0, 1].ses > 5 and got[0, 1].pc_p == 0.01 and got[0, 2].p > 0.01
        assert got[0, 1].r == pytest.approx(np.corrcoef(table)[0, 1])


def test_bootstrap_draws_empty_tiles(spark):
    rows = [(t, b, float(t % 3 + b)) for t in range(30) for b in range(2) for _ in range(1 + t % 4)]
    c = spark.createDataFrame(rows, "t int, bin int, v double")
    wide = {r.bin: r for r in inference.block_bootstrap(c, F.col("t"), 60, 2, 199).collect()}
    tight = {r.bin: r for r in inference.block_bootstrap(c, F.col("t"), 30, 2, 199).collect()}
    assert wide[0].lo < wide[0].g < wide[0].hi and wide[0].g == tight[0].g
    rng, sums = np.random.default_rng(0), np.array([[(1 + t % 4) * (t % 3), 1 + t % 4] for t in range(30)] + [[0, 0]] * 30, float)
    drawn = np.array([(lambda x: x[0] / x[1])(sums[rng.integers(0, 60, 60)].sum(0)) for _ in range(4000)])
    low, high = np.quantile(drawn, [0.025, 0.975])
    assert (wide[0].lo, wide[0].hi) == pytest.approx((2 * drawn.mean() - high, 2 * drawn.mean() - low), abs=0.12)
    same = inference.block_bootstrap(c.withColumn("v", F.lit(2.0)), F.col("t"), 60, 2, 50).first()
    assert same.lo == same.hi == 2.0


def test_null_mean_gram_is_the_mean_over_labels(spark):
    rng = np.random.default_rng(1)
    n, box = 60, (0.0, 0.0, 100.0, 100.0)
    xy, label = rng.uniform(20, 80, (n, 2)), np.repeat([0, 1], [40, 20])
    points = lambda lab: spark.createDataFrame([(i, float(x), float(y), int(k)) for i, ((x, y), k) in enumerate(zip(xy, lab))], "cell_id long, x double, y double, channel int")
    got = {(r.a, r.b): r.expected for r in density.null_mean_gram(points(label), box, 50, 50, 12.0, 1).collect()}
    px = (np.arange(50) + 0.5) * 2
    d2 = (xy[:, 0, None, None] - px[None, None]) ** 2 + (xy[:, 1, None, None] - px[None, :, None]) ** 2
    k = np.where(d2 < 144, 2 / (math.pi * 144) * (1 - d2 / 144), 0).reshape(n, -1)
    mean = np.zeros((2, 2))
    for _ in range(400):
        lab = rng.permutation(label)
        ras = np.stack([k[lab == t].sum(0) for t in range(2)])
        mean += ras @ ras.T * 4 / 400
    assert [got[0, 0], got[0, 1], got[1, 1]] == pytest.approx([mean[0, 0], mean[0, 1], mean[1, 1]], rel=0.03)


def test_lower_envelope():
    rng = np.random.default_rng(7)
    for n in (1, 2, 17, 60):
        f = np.where(rng.random(n) < 0.5, rng.integers(0, 200, n).astype(float), np.inf)
        i = np.arange(n)
        assert np.array_equal(grids._envelope(f), (f[None] + (i[:, None] - i[None]) ** 2).min(1))


def test_trees_and_noise(spark):
    p = spark.createDataFrame([(0.0, 0.0, 0.0), (3.0, 0.0, 0.0), (0.5, 0.25, -2.0)], "x double, y double, z double")
    at = (F.col("x"), F.col("y"), F.col("z"))
    d = [r.d for r in p.select(trees.distance(("intersect", ("sphere", 2.0), ("plane", 0.0, 0.0, 3.0, -1.0)), at).alias("d")).collect()]
    assert d == pytest.approx([1.0, 1.0, math.sqrt(0.25 + 0.0625 + 4) - 2])
    n = p.where("x = 3").select(F.array(*trees.normal(("sphere", 1.0), at)).alias("n")).first().n
    assert n == pytest.approx([1.0, 0.0, 0.0])
    rough = [r.d for r in p.select(trees.distance(("displace", ("sphere", 1.0), 0.2, 1.5), at).alias("d")).collect()]
    assert all(abs(a - b) <= 0.2 for a, b in zip(rough, [-1.0, 2.0, math.sqrt(4.3125) - 1], strict=True))
    with np.errstate(over="ignore"):
        assert np.abs(np.diff(trees.smooth_noise(np.stack([np.linspace(0, 5, 5001)] * 3)))).max() < 0.05
    with pytest.raises(ValueError):
        trees.distance(("cone", 1.0), at)


def test_spectra(spark):
    z = spark.createDataFrame([(0.0,), (0.5,), (3.0,), (11.0,), (40.0,)], "z double")
    got = [tuple(r) for r in z.select(*[spectra.bessel_j(m, F.col("z")) for m in (0, 1)], spectra.kernel_spectrum(1, F.col("z"))).collect()]
    assert [g[0] for g in got] == pytest.approx([1.0, 0.9384698072, -0.2600519549, -0.1711903004, 0.0073668905], abs=1e-9)
    assert got[2][1] == pytest.approx(0.3390589585, abs=1e-9) and got[0][2] == 1.0
    u = np.linspace(0, 1, 20001)
    j0 = np.mean([np.cos(0.5 * u * np.sin(t)) for t in np.arange(256) * 2 * np.pi / 256], 0)
    assert got[1][2] == pytest.approx(np.trapezoid((1 - u * u) * u * j0, u) / np.trapezoid((1 - u * u) * u, u), abs=1e-6)


def test_disk_in_a_polygon(spark):
    rings = [[(0.0, 0.0), (10.0, 0.0), (12.0, 7.0), (4.0, 9.0)], [(4.0, 3.0), (7.0, 3.0), (6.0, 5.0)]]
    rows = [(5.0, 4.0, 3.0), (0.0, 0.0, 2.0), (6.0, 4.0, 30.0), (20.0, 4.0, 5.0), (5.5, 3.5, 0.2)]
    df = spark.createDataFrame(rows, "x double, y double, r double")
    got = [r.a for r in df.select(geometry.disk_polygon_area(F.col("x"), F.col("y"), F.col("r"), rings[::-1]).alias("a")).collect()]
    gx, gy = np.meshgrid(np.arange(-2, 14, 0.02) + 0.01, np.arange(-2, 12, 0.02) + 0.01)
    inside = np.zeros(gx.shape, bool)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            with np.errstate(divide="ignore", invalid="ignore"):
                inside ^= ((ay > gy) != (by > gy)) & (gx < (bx - ax) * (gy - ay) / (by - ay) + ax)
    for (x, y, r), a in zip(rows, got, strict=True):
        assert a == pytest.approx((inside & ((gx - x) ** 2 + (gy - y) ** 2 < r * r)).sum() * 0.0004, abs=0.05)


def test_populations(spark):
    traits = populations.trait_space([{"name": "a", "type": "number", "min": 0, "max": 1}, {"name": "b", "type": "bool"}, {"name": "c", "type": "int", "min": 0, "max": 5}])
    start = spark.range(2000).select("id", F.array(F.lit(0.5), F.lit(0.02)).alias("pos"), F.array(F.lit(0.1), F.lit(0.2)).alias("vel"), F.array(F.lit(1)).alias("enable"))
    got = populations.mutate(start, traits, 0.1, 3).toPandas()
    x = np.stack(got["pos"])
    assert x.min() >= 0 and x[:, 0].std() == pytest.approx(0.1, rel=0.1) and np.mean([e[0] == 0 for e in got["enable"]]) == pytest.approx(0.1, abs=0.03)
    assert populations.mutate(start, traits, 0.1, 3).toPandas().equals(got)
    for parents, n in ((start.limit(0), 5), (start.limit(1), 5), (start.limit(3), 5)):
        assert populations.breed(parents, traits, n, 0.1).count() == n
    assert populations.breed(start.limit(3), traits, 4, 0.5, elite=True).where("id = 0").first().pos == [0.5, 0.02]
    tree = spark.createDataFrame([(1, "seed"), (2, "mutate")], "id int, op string")
    assert sorted(tuple(r) for r in populations.recorded(tree, spark.createDataFrame([(2, "x"), (3, "y"), (3, "y")], "id int, op string")).collect()) == [(1, "seed"), (2, "mutate"), (3, "y")]


def test_gene_modules_find_planted_ones(spark):
    rng = np.random.default_rng(3)
    rows = []
    for bx in range(12):
        for by in range(12):
            for code in range(9):
                mean = 3 + (12 if code % 3 == 0 and bx < 6 else 12 if code % 3 == 1 and by < 6 else 0)
                rows += [(bx * 10 + 5.0, by * 10 + 5.0, code)] * int(rng.poisson(mean))
    m = spark.createDataFrame(rows, "x double, y double, code int")
    emb, edge = modules.gene_embedding(modules.binned(m, 10.0))
    got = {r.code: r.module for r in modules.gene_modules(emb, 2).collect()}
    assert len({got[c] for c in (0, 3, 6)}) == len({got[c] for c in (1, 4, 7)}) == 1 and got[0] != got[1] and got[2] == got[5] == -1 and 0 < edge < 1


def test_wand(spark):
    rows = [(c, r, k, float((c + 1) * (k >= 5)) + (0.1 if c == 0 and r == 3 else 0)) for c in range(2) for r in range(8) for k in range(10)]
    g = spark.createDataFrame(rows, "channel int, row int, col int, v double")
    got = {(r.row, r.col): r.patch for r in wand.patch(g, 4, 2, tol=0.5, rho=1.0).collect()}
    assert set(got) == {(r, k) for r in range(8) for k in range(5)} and got[4, 2] and not got[0, 0]
    z = wand.standardised(g)
    values, rows_ = wand.modes(np.array([[1.0, 0.5], [0.5, 1.0]]))
    d = {(r.row, r.col): r.d for r in wand.similarity(z, wand.whitening(values, rows_, 2), wand.at_pixel(z, 4, 2)).collect()}
    zz = z.groupBy("row", "col").pivot("channel").agg(F.first("z")).toPandas().set_index(["row", "col"])
    gap = zz.loc[(1, 8)].to_numpy() - zz.loc[(4, 2)].to_numpy()
    assert d[4, 2] == 0 and d[1, 8] == pytest.approx(math.sqrt(gap @ np.linalg.inv([[1, 0.5], [0.5, 1]]) @ gap))
    assert (wand.aligned(-rows_, rows_) == rows_).all()


def test_planning(spark):
    assert planning.clamped_window((0, 0, 10, 10), (20, 20, 30, 30), 5) is None
    assert planning.clamped_window((0, 0, 10, 10), (-5, -5, 50, 50), 25) == pytest.approx((2.5, 2.5, 7.5, 7.5))
    box, w, h, cell = planning.density_grid((0, 0, 1000, 1000), (1000, 1000), (0, 0, 1000, 1000), 2.0, most_cells=100)
    assert w * h <= 100 and box[0] <= -6 and cell > 1
    made = []
    memo = planning.Memo(most=2, most_bytes=10, size=len)
    for k in ("aaaa", "bbbb", "aaaa", "cccc", "bbbb", "x" * 20):
        memo.get(k, lambda k=k: made.append(k) or k)
    assert made == ["aaaa", "bbbb", "cccc", "bbbb", "x" * 20] and memo.bytes <= 10 and len(memo.held) == 2
    assert planning.resolved([1, 1, 2], lambda k: k * 10, planning.Memo()) == {1: 10, 2: 20}
    df = spark.range(5)
    frames = planning.Memo()
    assert frames.frame(df.where("id > 2")) is frames.frame(spark.range(5).where("id > 2"))
    assert planning.stable_json({"b": [1, {"d": 2, "c": 1}], "a": None}) == '{"a":null,"b":[1,{"c":1,"d":2}]}'
    assert planning.resolved_unit("px", {"scale": 2.0}, [({"px"}, lambda u, c: c.get("scale"))]) == ("px", 2.0) and planning.resolved_unit("px", {}, [({"px"}, lambda u, c: c.get("scale"))]) is None
    got = planning.resolve_space([{"type": "affine", "affine": [[1, 0, 5], [0, 2, 7]]}])
    assert got["affine"] == planning.IDENTITY and got["unsupported"] == ["affine (unnamed axes)"] and planning.resolve_space([]) is None


def test_colours_and_curve(spark):
    a, b = vectors.fit_curve(0.1, 1.0)
    assert (a, b) == pytest.approx((1.577, 0.895), abs=2e-3)
    got = np.stack(spark.range(-5, 6).select(scales.diverging(F.col("id") / 5.0).alias("c")).toPandas()["c"])
    assert got.min() >= 0 and got.max() <= 1 and got[0][2] > got[0][0] and got[-1][0] > got[-1][2]
    assert np.allclose(got[5], got[5][0], atol=0.02)


def test_kernel_scores(spark):
    scene = generators.association_scene(spark, seed=2)
    got = {r.kernel: r for r in scoring.kernel_scores(scene, BOX, 60.0).collect()}
    assert len(got) == 5 and all(r.auc > 0.8 for r in got.values()) and len({round(r.moment2, 6) for r in got.values()}) == 1
    assert got["0"].tied > got["2"].tied and got["0"].radius_change > 0


def test_clusters_do_not_follow_the_partitions(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.4, (60, 2)) for c in ((0, 0), (9, 0), (0, 9))])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    one, two = (pd.DataFrame(vectors.emeans(df.repartition(n), 3, seed=2)[1]) for n in (1, 7))
    assert np.allclose(one, two) and vectors.batch_size(10, 500, 5) == 4


def test_trustworthiness_of_a_permutation(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 5))
    y = x[:, :2]
    frame = lambda a: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "id long, v array<double>")
    near = vectors.knn(frame(y), 4)
    got = vectors.trustworthiness(vectors.ranks_of(frame(x), near, block_rows=30), near, 4).first()[0]
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    low = ((y[:, None] - y[None]) ** 2).sum(2)
    np.fill_diagonal(d, -1)
    np.fill_diagonal(low, np.inf)
    rank = d.argsort(1).argsort(1)
    loss = sum(max(0, rank[i, j] - 4) for i in range(80) for j in low[i].argsort()[:4])
    assert got == pytest.approx(1 - 2 / (80 * 4 * (160 - 12 - 1)) * loss)
