"""Correlation, permutation tests, envelopes and rank statistics."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.checkpoints import saved
from quadrille.operators.lattice import exclusive_scan

NAN = float("nan")


def share(n: Column, d: Column) -> Column:
    """n / d, NaN where d is not positive."""
    return F.when(d > 0, n / d).otherwise(F.lit(NAN))


def row_correlation(counts: DataFrame, by: str, over: str, value: str) -> DataFrame:
    """Pearson correlation of all pairs of ``by`` over ``over``, from sums over a dense table: type_a, type_b, r.

    NaN where a side has no variance."""
    own = counts.groupBy(by).agg(F.sum(value).cast("double").alias("s"), F.sum(F.col(value) * F.col(value)).cast("double").alias("ss"), F.count("*").cast("double").alias("m"))
    slim = counts.where(F.col(value) != 0).select(by, over, value)
    other = slim.select(F.col(by).alias("type_b"), over, F.col(value).alias("_v"))
    products = slim.withColumnRenamed(by, "type_a").join(other, over).groupBy("type_a", "type_b").agg(F.sum(F.col(value) * F.col("_v")).cast("double").alias("ab"))
    full = own.toDF("type_a", "sa", "ssa", "m").crossJoin(F.broadcast(own.toDF("type_b", "sb", "ssb", "_m"))).join(products, ["type_a", "type_b"], "left").fillna(0.0, ["ab"])
    va, vb = F.col("m") * F.col("ssa") - F.col("sa") * F.col("sa"), F.col("m") * F.col("ssb") - F.col("sb") * F.col("sb")
    return full.select("type_a", "type_b", share(F.col("m") * F.col("ab") - F.col("sa") * F.col("sb"), F.sqrt(F.greatest(F.lit(0.0), va)) * F.sqrt(F.greatest(F.lit(0.0), vb))).alias("r"))


def partial_correlation(r: np.ndarray) -> np.ndarray:
    """Partial correlations of a K x K matrix; types without variance (NaN diagonal) are left out, a singular rest is all NaN."""
    out = np.full(r.shape, NAN)
    keep = np.flatnonzero(np.isfinite(np.diag(r)))
    if len(keep):
        own = r[np.ix_(keep, keep)]
        if np.linalg.matrix_rank(own) == len(keep):
            p = np.linalg.inv(own)
            d = np.sqrt(np.abs(np.diag(p)))
            part = -p / d[:, None] / d[None]
            np.fill_diagonal(part, 1.0)
            out[np.ix_(keep, keep)] = part
    return out


def benjamini_hochberg(tests: DataFrame, id_cols: list[str], p: str = "p") -> DataFrame:
    """Adds q. NaN and null p are not counted and get NaN. One window over all tests, so meant for tables of tests, not of rows."""
    known = tests.where(F.col(p).isNotNull() & ~F.isnan(p))
    every = Window.partitionBy(F.lit(0))
    ranked = known.withColumns({"_r": F.row_number().over(every.orderBy(F.col(p), *id_cols)), "_m": F.count("*").over(every)})
    ranked = ranked.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(every.orderBy(F.col("_r").desc())))).drop("_r", "_m")
    return ranked.unionByName(tests.where(F.col(p).isNull() | F.isnan(p)).withColumn("q", F.lit(NAN)))


def _correlated(x: np.ndarray) -> np.ndarray:
    z = x - x.mean(1, keepdims=True)
    s = np.sqrt((z * z).sum(1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return (z @ z.T) / s[:, None] / s[None]


def dealt_table(totals: np.ndarray, per_type: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A table of types by quadrats as random labels of the cells give it: one hypergeometric draw for each quadrat."""
    left, out = per_type.copy(), np.zeros((len(per_type), len(totals)), np.int64)
    for q in np.flatnonzero(totals):
        out[:, q] = rng.multivariate_hypergeometric(left, int(totals[q]), method="marginals")
        left -= out[:, q]
    return out


def swap(table: list[list[int]], rng: random.Random) -> bool:
    """One try to move counts around a rectangle of two rows and two columns, in place; row and column sums stay.

    Counts go off the main diagonal if both of its ends have some, else off the other one; from 1 to all that the smaller
    end holds. False if neither can give."""
    if len(table) < 2 or len(table[0]) < 2:
        return False
    (i, j), (c, d) = rng.sample(range(len(table)), 2), rng.sample(range(len(table[0])), 2)
    upper, lower = table[i], table[j]
    for most, sign in ((min(upper[c], lower[d]), -1), (min(upper[d], lower[c]), 1)):
        if most:
            n = sign * rng.randint(1, most)
            upper[c], lower[d] = upper[c] + n, lower[d] + n
            upper[d], lower[c] = upper[d] - n, lower[c] - n
            return True
    return False


def swap_chain(table: list[list[int]], moves: int, rng: random.Random) -> int:
    """Swaps until so many have moved something (or 200 tries for each have been made); how many did."""
    done = 0
    for _ in range(200 * moves + 1000):
        if done >= moves:
            break
        done += swap(table, rng)
    return done


def quadrat_null(counts: DataFrame, by: str, over: str, value: str, types: int, simulations: int, seed: int = 0, null: str = "label", burn_in: int = 10_000, between: int = 500, chains: int = 8) -> DataFrame:
    """Correlations of types over quadrats against a null: type_a, type_b, r, ses, p, q, and pc, pc_ses, pc_p, pc_q of the
    partial correlations.

    The table of quadrat counts (bounded by the window, the quadrats' size and the types) is sent to the simulations,
    which are rows of a range. "label" deals the labels anew over the cells; "swap" walks through the tables with the
    same margins, in ``chains`` chains that start from the observed one and forget it during ``burn_in`` moves."""
    if null not in ("label", "swap"):
        raise ValueError("null is label or swap")
    pdf = counts.orderBy(by, over).toPandas()
    m = pdf.pivot(index=by, columns=over, values=value).reindex(range(types), fill_value=0).to_numpy(np.int64)
    totals, per_type = m.sum(0), m.sum(1)

    def rows_of(i: int, x: np.ndarray) -> list[tuple]:
        r = _correlated(x)
        pc = partial_correlation(r)
        return [(int(i), a, c, r[a, c], pc[a, c]) for a in range(types) for c in range(types)]

    def simulate(batches):
        for b in batches:
            out = []
            for i in b["id"]:
                if null == "label":
                    out += rows_of(i, dealt_table(totals, per_type, np.random.Generator(np.random.PCG64([seed, int(i)]))))
                else:  # one chain: its draws follow each other
                    rng, table = random.Random(f"{seed} {i}"), m.tolist()
                    for n, draw in enumerate(range(int(i), simulations, chains)):
                        swap_chain(table, between if n else burn_in, rng)
                        out += rows_of(draw, np.array(table))
            yield pd.DataFrame(out, columns=["sim", "type_a", "type_b", "r", "pc"])

    spark = counts.sparkSession
    units = simulations if null == "label" else min(chains, simulations)
    draws = spark.range(0, units, 1, min(units, 64)).mapInPandas(simulate, "sim long, type_a int, type_b int, r double, pc double")
    own = _correlated(m)
    part = partial_correlation(own)
    observed = spark.createDataFrame([(a, c, float(own[a, c]), float(part[a, c])) for a in range(types) for c in range(types)], "type_a int, type_b int, r0 double, pc0 double")
    both = saved(draws).join(F.broadcast(observed), ["type_a", "type_b"])
    out = None
    for x, prefix in (("r", ""), ("pc", "pc_")):
        sums = both.where(~F.isnan(x)).groupBy("type_a", "type_b", f"{x}0").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.count_if(F.abs(x) >= F.abs(f"{x}0")).alias("as_far"))
        tests = sums.select("type_a", "type_b", F.col(f"{x}0").alias(x), share(F.col(f"{x}0") - F.col("mean"), F.col("sd")).alias(f"{prefix}ses"), ((F.col("as_far") + 1) / (simulations + 1.0)).alias(f"{prefix}p"))
        upper = benjamini_hochberg(tests.where("type_a < type_b"), ["type_a", "type_b"], f"{prefix}p").withColumnRenamed("q", f"{prefix}q")
        tests = tests.join(upper.select("type_a", "type_b", f"{prefix}q"), ["type_a", "type_b"], "left")
        out = tests if out is None else out.join(tests, ["type_a", "type_b"], "left")
    return out


def rank_envelope(curves: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Global envelope by extreme rank length over (sim, r, v), sim 0 observed: r, observed, lo, hi, p, exits.

    Curves are ranked at every r from both ends, a curve's sorted ranks order it, and the floor(alpha n) most extreme
    curves are left out of the band. Raises ValueError if that is none."""
    n = curves.select("sim").distinct().count()
    gone = int(alpha * n + 1e-9)
    if gone < 1:
        raise ValueError("too few curves for this alpha")
    at = Window.partitionBy("r")
    low, high = F.rank().over(at.orderBy("v")), F.rank().over(at.orderBy(F.col("v").desc()))
    ranked = curves.withColumn("k", F.least(low, high))
    order = ranked.groupBy("sim").agg(F.sort_array(F.collect_list("k")).alias("ks"))
    order = order.withColumn("place", F.rank().over(Window.partitionBy(F.lit(0)).orderBy("ks")))
    # observed curve counted among those at least as extreme
    p = order.crossJoin(F.broadcast(order.where("sim = 0").select(F.col("ks").alias("k0")))).agg((F.count_if(F.col("ks") <= F.col("k0")) / F.lit(float(n))).alias("p"))
    kept = order.withColumn("row", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ks", "sim"))).where(F.col("row") > gone).select("sim")
    band = curves.join(kept, "sim").groupBy("r").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    seen = curves.where("sim = 0").select("r", F.col("v").alias("observed"))
    out = seen.join(band, "r").crossJoin(F.broadcast(p))
    return out.select("r", "observed", "lo", "hi", "p", ((F.col("observed") < F.col("lo")) | (F.col("observed") > F.col("hi"))).alias("exits"))


def auc(scored: DataFrame, value: str, positive: str) -> DataFrame:
    """Mann-Whitney area with mid-ranks, 0.5 if a class is empty: auc. Equal values are pooled first, then ranked by running
    totals over ranges of values, so no window runs over all of them."""
    pooled = scored.groupBy(value).agg(F.count_if(positive).alias("np"), F.count_if(~F.col(positive)).alias("nn"))
    runs = exclusive_scan(saved(pooled), value, "nn")
    s = runs.agg(F.sum(F.col("np") * (F.col("scan") + F.col("nn") / 2.0)).alias("u"), F.sum("np").alias("p"), F.sum("nn").alias("n"))
    return s.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))).otherwise(0.5).alias("auc"))


def block_bootstrap(contributions: DataFrame, tile: Column, tiles: int, bins: int, resamples: int, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Bootstrap interval by tiles for per-anchor contributions (bin, v; one row for each anchor and bin): bin, g, mean, lo, hi.

    A resample draws as many of the ``tiles`` as there are, empty ones included, and divides the drawn contributions by
    the drawn anchors; without anchors it is g, the mean of all. The interval is reflected about the mean of resamples."""
    held = contributions.withColumn("_tile", tile.cast("long"))
    sums = held.groupBy("_tile", "bin").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    g = held.groupBy("bin").agg(F.avg("v").alias("g"))
    spark = contributions.sparkSession
    draws = spark.range(resamples).withColumnRenamed("id", "sim").crossJoin(spark.range(tiles).withColumnRenamed("id", "draw"))
    times = draws.withColumn("_tile", F.pmod(F.xxhash64("sim", "draw", F.lit(seed)), F.lit(tiles))).groupBy("sim", "_tile").agg(F.count("*").alias("k"))
    drawn = times.join(sums, "_tile").groupBy("sim", "bin").agg((F.sum(F.col("k") * F.col("v")) / F.sum(F.col("k") * F.col("n"))).alias("m"))
    frame = spark.range(resamples).withColumnRenamed("id", "sim").crossJoin(F.broadcast(spark.range(bins).select(F.col("id").cast("int").alias("bin"))))
    full = frame.join(drawn, ["sim", "bin"], "left").join(F.broadcast(g), "bin").withColumn("m", F.coalesce("m", "g"))
    low, high = int(alpha / 2 * (resamples - 1)), -int(-(1 - alpha / 2) * (resamples - 1) // 1)
    got = full.groupBy("bin", "g").agg(F.avg("m").alias("mean"), F.sort_array(F.collect_list("m")).alias("ms"))  # ``resamples`` numbers each
    return got.select("bin", "g", "mean", (2 * F.col("mean") - F.get("ms", F.lit(high))).alias("lo"), (2 * F.col("mean") - F.get("ms", F.lit(low))).alias("hi"))


def excursions(envelope: DataFrame) -> DataFrame:
    """Where an envelope's observed curve leaves its band: r, observed, bound, above."""
    above = F.col("observed") > F.col("hi")
    return envelope.where("exits").select("r", "observed", F.when(above, F.col("hi")).otherwise(F.col("lo")).alias("bound"), above.alias("above"))
