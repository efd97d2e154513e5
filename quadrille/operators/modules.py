"""Spatial modules of genes: bins of molecules, an embedding of the genes, clusters of it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.checkpoints import saved
from quadrille.operators.vectors import covariance, moving_means


def bin_size(molecules: DataFrame, per_bin: float = 750.0) -> float:
    """Side of square bins that hold ``per_bin`` molecules on average over the extent of the molecules."""
    m = molecules.agg(F.count("*").alias("n"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area")).first()
    if not m["n"] or not m["area"]:
        raise ValueError("the molecules have no extent")
    return float((per_bin * m["area"] / m["n"]) ** 0.5)


def binned(molecules: DataFrame, size: float, min_gene: int = 30, min_bin: int = 20, target: float = 1e4) -> DataFrame:
    """Entries of the matrix of bins and genes: bin (x and y steps), code, n, value = log(1 + n target / molecules of the bin).

    Genes of fewer than ``min_gene`` molecules go first, then bins of fewer than ``min_bin``."""
    genes = molecules.groupBy("code").agg(F.count("*").alias("_g")).where(F.col("_g") >= min_gene).select("code")
    at = F.struct(F.floor(F.col("x") / size).alias("bx"), F.floor(F.col("y") / size).alias("by"))
    entries = molecules.join(F.broadcast(genes), "code").groupBy(at.alias("bin"), "code").agg(F.count("*").alias("n"))
    sizes = entries.groupBy("bin").agg(F.sum("n").alias("_s")).where(F.col("_s") >= min_bin)
    return entries.join(sizes, "bin").select("bin", "code", "n", F.log1p(F.col("n") * target / F.col("_s")).alias("value"))


def gene_embedding(entries: DataFrame, most: int = 30, clip: float = 10.0) -> tuple[DataFrame, float]:
    """((code, loadings, molecules), noise edge): correlations of each gene with the components of the standardised bins.

    Values are cut at ``clip`` deviations above the gene's mean over all bins, empty ones included. Components whose share
    of the variance stays below that of a random matrix, (1 + sqrt(G / B))^2 / G, are left out, but for the first.
    G x G numbers reach the driver, G genes."""
    entries = saved(entries)
    bins = entries.select("bin").distinct().count()
    codes = [r[0] for r in entries.select("code").distinct().orderBy("code").collect()]
    if bins < 2 or not codes:
        raise ValueError(f"too little data: {bins} bins, {len(codes)} genes")
    g = len(codes)
    m = entries.groupBy("code").agg((F.sum("value") / bins).alias("mean"), (F.sum(F.col("value") * F.col("value")) / bins).alias("sq"), F.sum("n").alias("molecules"))
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("sq") - F.col("mean") * F.col("mean")))
    m = saved(m.withColumn("sd", F.when(sd > 0, sd).otherwise(1.0)))
    known = {r["code"]: r for r in m.collect()}
    cut = entries.join(F.broadcast(m), "code").select("bin", "code", (F.least(F.col("value"), F.col("mean") + clip * F.col("sd")) / F.col("sd")).alias("z"))
    place = F.create_map(*[F.lit(x) for i, c in enumerate(codes) for x in (c, i)])
    held = cut.groupBy("bin").agg(F.map_from_entries(F.collect_list(F.struct(F.element_at(place, F.col("code")).alias("i"), "z"))).alias("e"))
    dense = held.select(F.transform(F.sequence(F.lit(0), F.lit(g - 1)), lambda i: F.coalesce(F.try_element_at("e", i), F.lit(0.0))).alias("v"))
    n, mean, cov = covariance(dense)
    # second moments about the means of the uncut values
    base = np.array([known[c]["mean"] / known[c]["sd"] for c in codes])
    gap = mean - base
    second = cov * (n - 1) / n + np.outer(gap, gap)
    values, vectors = np.linalg.eigh(second)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    edge = (1 + np.sqrt(g / bins)) ** 2 / g
    share = values / g
    kept = max(1, int((np.cumprod(share[: min(most, g, bins - 1)] > edge)).sum()))
    loadings = vectors[:, :kept] * np.sqrt(values[:kept])
    signs = np.sign(loadings[np.abs(loadings).argmax(0), np.arange(kept)])
    loadings *= np.where(signs == 0, 1, signs)
    spark = entries.sparkSession
    rows = [(c, [float(x) for x in loadings[i]], int(known[c]["molecules"])) for i, c in enumerate(codes)]
    return spark.createDataFrame(rows, f"code {entries.schema['code'].dataType.simpleString()}, loadings array<double>, molecules long"), float(edge)


def gene_modules(embedding: DataFrame, k: int, least: float = 0.1, restarts: int = 5, epochs: int = 10, seed: int = 0) -> DataFrame:
    """Clusters of the genes whose communality (squared loadings summed) is at least ``least``: module, place, code, communality.

    Of several starts the one of least error is kept. Module 0 has most molecules; genes without structure have module -1.
    The table has a row for each gene, so it is clustered on the driver."""
    got = embedding.toPandas()
    x = np.stack(got["loadings"].to_numpy())
    common = (x * x).sum(1)
    keep = np.flatnonzero(common >= least)
    if len(keep) < k:
        raise ValueError(f"only {len(keep)} genes are structured enough for {k} modules")
    best = None
    for r in range(restarts):
        c = moving_means(x[keep], k, epochs, seed + r, spread=True)
        for _ in range(20):  # exact means at the end
            near = ((x[keep][:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.array([x[keep][near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
        error = ((x[keep] - c[near]) ** 2).sum()
        if best is None or error < best[0]:
            best = error, near
    label = np.full(len(x), -1)
    sizes = np.array([got["molecules"].to_numpy()[keep][best[1] == j].sum() for j in range(k)])
    rank = np.empty(k, int)
    rank[np.argsort(-sizes, kind="stable")] = np.arange(k)
    label[keep] = rank[best[1]]
    rows = []
    for m in sorted(set(label.tolist())):
        members = np.flatnonzero(label == m)
        rows += [(int(m), p, got["code"].iloc[i].item(), float(common[i])) for p, i in enumerate(members[np.argsort(-common[members], kind="stable")].tolist())]
    spark = embedding.sparkSession
    return spark.createDataFrame(rows, f"module int, place int, code {embedding.schema['code'].dataType.simpleString()}, communality double")
