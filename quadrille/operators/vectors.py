"""Feature vectors: exact and approximate neighbours, PCA, clustering, embedding graphs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.checkpoints import saved
from quadrille.functions.algebra import dot


def _block_of(n_blocks: int):
    return F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")


def _packed(df: DataFrame, *columns: str) -> tuple[DataFrame, bool]:
    """v as floats where they are the same numbers, in half the bytes; whether they are."""
    short = df.where(F.exists("v", lambda x: x != x.cast("float").cast("double"))).isEmpty()
    return (df.select(*columns, F.col("v").cast("array<float>").alias("v")) if short else df.select(*columns, "v")), short


def _matrix(t: pa.Table, column: str = "v") -> np.ndarray:
    """The rows of a column of equally long arrays."""
    return np.asarray(t.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(t.num_rows, -1)


#: Fixed value: blocks on each side, so that a small table is still many tasks.
BLOCKS = 6


def _blocks(n: int, block_rows: int) -> int:
    return max(1, -(-n // block_rows), min(BLOCKS, n // 1024))


def knn(vectors: DataFrame, k: int, queries: DataFrame | None = None, block_rows: int = 16384) -> DataFrame:
    """Exact k nearest other vectors: i, rank, j, d; ties go to the lower id.

    Rows are dealt to blocks; each pair of blocks is one task of matrix products that keeps k candidates of each row, and
    the candidates of a row are merged by a window. A row is kept as a candidate if it lies within the bound that the
    products before have given. Work is n^2, memory is bounded by two blocks, and rows are sent once for each block."""
    queries = vectors if queries is None else queries
    (held, _), (asked, _) = _packed(vectors, "id"), _packed(queries, "id")
    nb, nq = _blocks(vectors.count(), block_rows), _blocks(queries.count(), block_rows)
    held = held.withColumn("pb", _block_of(nb)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    asked = asked.withColumn("qb", _block_of(nq)).withColumn("pb", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))

    def best(q: pa.Table, p: pa.Table) -> pa.Table:
        schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("d2", pa.float64())])
        if not q.num_rows or not p.num_rows:
            return schema.empty_table()
        order = np.argsort(p.column("id").to_numpy(), kind="stable")
        qi, pi, qv, pv = q.column("id").to_numpy(), p.column("id").to_numpy()[order], _matrix(q), _matrix(p)[order]
        qs, ps, out = (qv**2).sum(1), (pv**2).sum(1), []
        slack = 1e-12 * max(1.0, float(qs.max()), float(ps.max()))  # of the products against the differences
        m, every = min(k + 8, len(pi)), max(256, k + 8)
        for s in range(0, len(qi), 256):
            a, a2, ai = qv[s : s + 256], qs[s : s + 256], qi[s : s + 256]
            bound, rows, places = np.full(len(a), np.inf), [], []
            for e in range(0, len(pi), 4096):
                d = a @ pv[e : e + 4096].T
                d *= -2
                d += ps[None, e : e + 4096]
                d += a2[:, None]
                d[ai[:, None] == pi[None, e : e + 4096]] = np.inf
                if d.shape[1] >= every and not e:  # a first bound, of the first rows
                    bound = np.partition(d, m - 1, 1)[:, m - 1] + slack
                x, y = np.nonzero(d <= bound[:, None])
                rows.append(x)
                places.append(y + e)
            x, y = np.concatenate(rows), np.concatenate(places)
            d2 = ((a[x] - pv[y]) ** 2).sum(1) if len(x) < 1 << 20 else np.concatenate([((a[x[c : c + (1 << 18)]] - pv[y[c : c + (1 << 18)]]) ** 2).sum(1) for c in range(0, len(x), 1 << 18)])
            ok = ai[x] != pi[y]
            x, y, d2 = x[ok], y[ok], d2[ok]
            o = np.lexsort((y, d2, x))
            x, y, d2 = x[o], y[o], d2[o]
            near = np.arange(len(x)) - np.searchsorted(x, np.arange(len(a)))[x] < k
            out.append((ai[x[near]], pi[y[near]], d2[near]))
        return pa.table([pa.array(np.concatenate([x[c] for x in out])) for c in range(3)], schema=schema)

    pairs = asked.groupBy("qb", "pb").cogroup(held.groupBy("qb", "pb")).applyInArrow(best, "i long, j long, d2 double")
    order = Window.partitionBy("i").orderBy("d2", "j")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("i", "rank", "j", F.sqrt("d2").alias("d"))


def knn_approx(vectors: DataFrame, k: int, projections: int = 6, reach: int = 12, rounds: int = 12, seed: int = 42, tol: float = 0.001, width: int | None = None) -> DataFrame:
    """Neighbours by descent: rows near each other on random projections, then neighbours of neighbours: i, rank, j, d.

    Projections are range-sorted by Spark; a row is offered those within ``reach`` places inside its range. Lists hold
    ``width`` neighbours (three times k, 30 at least). In a round, the neighbours of each row, with as many of the rows
    that have it as neighbour (the least hashes), are offered to each other, but for pairs of which neither is new.
    Rounds end when at most ``tol`` of all n k neighbours change, or after ``rounds``, as in the reference."""
    width = max(30, 3 * k) if width is None else width
    dim = len(vectors.first()["v"])
    rng = np.random.Generator(np.random.PCG64(seed))
    slim = saved(vectors.select(F.col("id").cast("long").alias("id"), "v"))
    n, pair = slim.count(), "id long, j long, d2 double"
    short = slim.select("id", F.col("v").cast("array<float>").alias("v"))
    if slim.where(F.col("v") != F.col("v").cast("array<float>").cast("array<double>")).isEmpty():
        slim = short  # the same numbers in half the bytes
    matrix = lambda column: np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dim)

    def along(batches):
        ids, v = np.empty(0, np.int64), np.empty((0, dim))
        for b in batches:
            start = len(ids)  # rows of the last batch, already offered to each other
            ids, v = np.concatenate([ids, b.column(0).to_numpy()]), np.concatenate([v, matrix(b.column(1))])
            for o in range(1, reach + 1):
                s = max(start, o)
                d2 = ((v[s:] - v[s - o : len(v) - o]) ** 2).sum(1) if s < len(v) else np.empty(0)
                x, y = ids[s:], ids[s - o : s - o + len(d2)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x, y])), pa.array(np.concatenate([y, x])), pa.array(np.concatenate([d2, d2]))], names=["id", "j", "d2"])
            ids, v = ids[-reach:], v[-reach:]

    def nearest(pairs: DataFrame) -> DataFrame:
        one = pairs.groupBy("id", "j").agg(F.min("d2").alias("d2"), F.min("new").alias("new"))
        ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("d2", "j"))).where(F.col("rank") <= width)
        return saved(ranked.select("id", "j", "d2", "new", "rank"))

    offered = None
    for _ in range(projections):
        w = F.array(*[F.lit(float(x)) for x in rng.normal(size=dim)])
        line = slim.withColumn("s", dot(F.col("v").cast("array<double>"), w)).repartitionByRange(max(1, slim.rdd.getNumPartitions()), "s").sortWithinPartitions("s", "id")
        near = line.select("id", "v").mapInArrow(along, pair)
        offered = near if offered is None else offered.unionAll(near)
    best = nearest(offered.withColumn("new", F.lit(1)))

    def local(t: pa.Table) -> pa.Table:
        t = t.sort_by([("p", "ascending"), ("m", "ascending")]).combine_chunks()
        p, m, new, far, v = t.column("p").to_numpy(), t.column("m").to_numpy(), t.column("new").to_numpy() > 0, t.column("far").to_numpy(), matrix(t.column("v").combine_chunks())
        ends, out = np.append(np.flatnonzero(np.diff(p)) + 1, len(p)), []
        start = 0
        for end in ends:
            x, fresh, ids = v[start:end], new[start:end], m[start:end]
            d2 = ((x[:, None] - x[None]) ** 2).sum(2)
            a, c = np.nonzero((fresh[:, None] | fresh[None]) & (d2 <= far[start:end, None]) & ~np.eye(len(x), dtype=bool))
            out.append((ids[a], ids[c], d2[a, c]))
            start = end
        found = [np.concatenate([x[c] for x in out]) for c in range(3)]
        order = np.lexsort((found[1], found[0]))  # a pair once
        found = [x[order] for x in found]
        keep = np.ones(len(order), bool)
        keep[1:] = (found[0][1:] != found[0][:-1]) | (found[1][1:] != found[1][:-1])
        return pa.table({"id": found[0][keep], "j": found[1][keep], "d2": found[2][keep]})

    for r in range(rounds):
        edges = best.select(F.col("id").alias("p"), F.col("j").alias("m"), "new")
        back = edges.select(F.col("m").alias("p"), F.col("p").alias("m"), "new")
        back = back.withColumn("_r", F.row_number().over(Window.partitionBy("p").orderBy(F.xxhash64("m", "p", F.lit(r))))).where(F.col("_r") <= width).drop("_r")
        members = edges.unionAll(back).groupBy("p", "m").agg(F.max("new").alias("new"))
        far = best.where(F.col("rank") == width).select("id", F.col("d2").alias("far"))
        nodes = slim.join(far, "id", "left").select(F.col("id").alias("m"), "v", F.coalesce("far", F.lit(float("inf"))).alias("far"))
        dealt = members.join(nodes, "m").withColumn("block", F.pmod(F.xxhash64("p"), F.lit(max(1, -(-n // 256)))))
        found = dealt.select("block", "p", "m", "new", "far", "v").groupBy("block").applyInArrow(lambda t: local(t.drop_columns("block")), pair)
        best = nearest(best.select("id", "j", "d2", F.lit(0).alias("new")).unionAll(found.withColumn("new", F.lit(1))))
        if best.where((F.col("new") == 1) & (F.col("rank") <= k)).count() <= tol * n * k:
            break
    return best.where(F.col("rank") <= k).select(F.col("id").alias("i"), "rank", "j", F.sqrt("d2").alias("d"))


def recall(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact neighbours that were found: recall."""
    hit = exact.select("i", "j").join(approx.select("i", "j").distinct().withColumn("hit", F.lit(1)), ["i", "j"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))


def column_moments(vectors: DataFrame) -> DataFrame:
    """Per dimension: mean, scale = 1 / sample deviation (1 if that is at most 1e-12)."""
    long = vectors.select(F.posexplode("v").alias("dim", "x"))
    s = long.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    return s.select("dim", "mean", F.when(F.col("sd") > 1e-12, 1 / F.col("sd")).otherwise(1.0).alias("scale"))


def covariance(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, sample covariance), summed per batch of rows and then over batches; K x K numbers reach the driver."""
    dim = len(vectors.first()["v"])

    def partial(batches):
        n, s, ss = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            x = np.stack(b["v"].to_numpy())
            n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s], "ss": [ss.ravel()]})

    parts = vectors.select("v").mapInPandas(partial, "n long, s array<double>, ss array<double>")
    total = lambda c, m: F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(m)])
    long = parts.select("n", F.posexplode(F.concat("s", "ss")).alias("i", "x"))
    got = long.groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").toPandas()
    n, x = int(got["n"].iloc[0]), got["x"].to_numpy()
    mean = x[:dim] / n
    cov = (x[dim:].reshape(dim, dim) - n * np.outer(mean, mean)) / max(1, n - 1)
    return n, mean, (cov + cov.T) / 2


def basis(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(explained variances, components as rows), largest first, the largest loading of each positive."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    rows = vectors[:, order].T
    signs = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(1)])
    return values[order], rows * np.where(signs == 0, 1, signs)[:, None]


def pca(vectors: DataFrame, k: int, standardise: bool = False) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(id, scores; components; explained variances)."""
    _, mean, cov = covariance(vectors)
    sd = np.sqrt(np.diag(cov))
    scale = np.where(sd > 1e-12, 1 / np.where(sd > 1e-12, sd, 1), 1.0) if standardise else np.ones(len(mean))
    explained, rows = basis(cov * scale[:, None] * scale[None], k)
    literal = lambda a: F.array(*[F.lit(float(x)) for x in a])
    centred = F.zip_with("v", literal(mean), lambda a, b: a - b)
    scores = vectors.withColumn("_c", centred).select("id", F.array(*[dot(F.col("_c"), literal(r * scale)) for r in rows]).alias("scores"))
    return scores, rows, explained


def _labelled(samples: DataFrame, centroids: list[list[float]], weight: str | None = None) -> DataFrame:
    """The samples with their label and d2."""
    gaps = []
    for c in centroids:
        gap = F.zip_with("v", F.array(*[F.lit(float(x)) for x in c]), lambda a, b: a - b)
        gaps.append(dot(gap, gap))
    held = samples.withColumn("_d", F.array(*gaps))
    label = F.array_position("_d", F.array_min("_d")) - 1
    if weight:
        label = F.when(F.col(weight) > 0, label).otherwise(-1)
    return held.withColumns({"label": label.cast("int"), "d2": F.array_min("_d")}).drop("_d")


def assign(samples: DataFrame, centroids: list[list[float]], weight: str | None = None) -> DataFrame:
    """id, label of the nearest centroid (the lower on ties; -1 for weight 0), d2. The centroids are part of the plan."""
    return _labelled(samples, centroids, weight).select("id", "label", "d2")


def lloyd(samples: DataFrame, centroids: list[list[float]], rounds: int, weight: str | None = None) -> list[list[float]]:
    """Lloyd's rounds from given centroids; an empty cluster keeps its centroid. K x D numbers reach the driver.

    A round is one scan: labels are expressions of the row, sums are partial before the shuffle of K x D rows."""
    w = F.col(weight) if weight else F.lit(1.0)
    held = samples.select("id", "v", w.alias("_w"))
    for _ in range(rounds):
        long = _labelled(held, centroids).select("label", "_w", F.posexplode("v").alias("dim", "x"))
        sums = long.groupBy("label", "dim").agg(F.sum(F.col("x") * F.col("_w")).alias("s"), F.sum("_w").alias("w")).collect()
        new = [list(c) for c in centroids]
        for r in sums:
            if r["w"] > 0:
                new[r["label"]][r["dim"]] = r["s"] / r["w"]
        centroids = new
    return centroids


SAMPLE = 1 << 16


def batch_size(k: int, n: int, epochs: int) -> int:
    """Rows of a mini-batch for k clusters of n rows: a power of two, at most half the rows."""
    wanted = round(np.log2(0.00439 * k**0.135 * n**0.876 * epochs**0.813)) if n > 1 else 0
    return 2 ** max(0, min(int(np.log2(max(2, n) / 2)), wanted))


def moving_means(x: np.ndarray, k: int, epochs: int = 5, seed: int = 0, spread: bool = False) -> np.ndarray:
    """Centroids of the rows of x by mini-batches: every batch draws the centroids towards the means of their rows, with a
    rate that falls to zero over all batches. A cluster that an epoch leaves empty splits the heaviest one. ``spread``:
    the first centroids are drawn apart, by squared distance from those before."""
    rng = np.random.Generator(np.random.PCG64(seed))
    c = x[rng.permutation(len(x))[:k]].copy()
    if spread:
        c = x[[rng.integers(len(x))]]
        while len(c) < min(k, len(x)):
            far = ((x[:, None] - c[None]) ** 2).sum(2).min(1)
            c = np.concatenate([c, x[[rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(x))]]])
    size = batch_size(k, len(x), epochs)
    steps, step = max(1, (epochs - 1) * -(-len(x) // size)), 0
    for _ in range(max(1, epochs - 1)):
        order, seen = rng.permutation(len(x)), np.zeros(len(c))
        for at in range(0, len(x), size):
            part = x[order[at : at + size]]
            near = ((part[:, None] - c[None]) ** 2).sum(2).argmin(1)
            n = np.bincount(near, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, near, part)
            full = n > 0
            c[full] += 0.5 * (1 - step / steps) * (sums[full] / n[full, None] - c[full])
            seen += n
            step += 1
        for dead in np.flatnonzero(seen == 0):
            big = int(seen.argmax())
            c[dead] = c[big] + 1e-3 * (x.std(0) + 1e-12)
            seen[big] = seen[dead] = seen[big] / 2
    return c


def emeans(samples: DataFrame, k: int, epochs: int = 5, seed: int = 0, sample: int = SAMPLE) -> tuple[DataFrame, list[list[float]]]:
    """(labels, centroids): mini-batches on the driver over at most about ``sample`` rows (those of the least hashes, so the
    result doesn't follow the partitioning), then exact means and labels of all rows."""
    known = samples.where(F.col("v").isNotNull())
    n = known.count()
    if not n:
        raise ValueError("no rows to cluster")
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    rows = known.select("id", "v").orderBy("id").toPandas()
    c = moving_means(np.stack(rows["v"].to_numpy()).astype(float), min(k, len(rows)), epochs, seed)
    c = np.array(lloyd(samples, c.tolist(), 1))
    return assign(samples, c.tolist()), c.tolist()


def smooth_distances(neighbours: DataFrame, target: float | None = None) -> DataFrame:
    """Adds rho and sigma to lists (i, ds ascending): sigma by bisection so that the sum of exp(-(d - rho)+ / sigma) is
    log2 of the neighbours and the point itself."""

    @F.pandas_udf("struct<rho:double,sigma:double>")
    def solve(ds: pd.Series) -> pd.DataFrame:
        out = []
        for d in ds:
            d = np.asarray(d, float)
            goal = target or np.log2(len(d) + 1)
            positive = d[d > 0]
            rho = positive[0] if len(positive) else 0.0
            lo, hi, sigma = 0.0, np.inf, 1.0
            for _ in range(64):
                total = np.exp(-np.maximum(0, d - rho) / sigma).sum()
                if abs(total - goal) < 1e-5:
                    break
                if total > goal:
                    hi = sigma
                    sigma = (lo + hi) / 2
                else:
                    lo = sigma
                    sigma = sigma * 2 if hi == np.inf else (lo + hi) / 2
            least = 1e-3 * d.mean() if len(d) else 0.0
            out.append((rho, max(sigma, least)))
        return pd.DataFrame(out, columns=["rho", "sigma"])

    return neighbours.withColumn("_s", solve("ds")).select("*", "_s.rho", "_s.sigma").drop("_s")


def fuzzy_set(edges: DataFrame, mix: float = 1.0) -> DataFrame:
    """Symmetric memberships of (i, j, d) edges: i, j, w; both directions stored."""
    lists = edges.groupBy("i").agg(F.sort_array(F.collect_list("d")).alias("ds"))
    known = smooth_distances(lists).select("i", "rho", "sigma")
    mu = edges.join(known, "i").select("i", "j", F.exp(-F.greatest(F.lit(0.0), F.col("d") - F.col("rho")) / F.col("sigma")).alias("m"))
    back = mu.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("m").alias("t"))
    both = mu.join(back, ["i", "j"], "full").fillna(0.0, ["m", "t"])
    product = F.col("m") * F.col("t")
    return both.select("i", "j", (mix * (F.col("m") + F.col("t") - product) + (1 - mix) * product).alias("w")).where("w > 0")


def trustworthiness(high: DataFrame, low: DataFrame, k: int) -> DataFrame:
    """1 - 2 / (n k (2n - 3k - 1)) * sum of how far the k nearest in ``low`` (i, j, rank) rank beyond k in ``high`` (i, j,
    rank of those pairs)."""
    n = low.select("i").distinct().count()
    near = low.where(F.col("rank") <= k).select("i", "j")
    far = near.join(high.select("i", "j", "rank"), ["i", "j"]).where(F.col("rank") > k)
    return far.agg((1 - F.coalesce(F.sum(F.col("rank") - k), F.lit(0)) * (2.0 / (n * k * (2 * n - 3 * k - 1)))).alias("trustworthiness"))


def ranks_of(vectors: DataFrame, pairs: DataFrame, block_rows: int = 16384) -> DataFrame:
    """Ranks by distance of given pairs among all other vectors of i: i, j, rank. Of each row only its pairs' distances are
    held, and rows that lie nearer are counted block by block."""
    to = vectors.select(F.col("id").alias("j"), F.col("v").alias("u"))
    asked = pairs.select("i", "j").join(vectors.select(F.col("id").alias("i"), "v"), "i").join(to, "j")
    gap = F.zip_with("v", "u", lambda a, b: a - b)
    own = asked.withColumn("_g", gap).groupBy("i").agg(F.first("v").alias("v"), F.sort_array(F.collect_list(F.struct(dot(F.col("_g"), F.col("_g")).alias("d2"), "j"))).alias("near"))
    own = saved(own)
    n, m = vectors.count(), own.count()
    nb, nq = (_blocks(x, block_rows) for x in (n, m))
    held = _packed(vectors, "id")[0].withColumn("pb", _block_of(nb)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    lists = _packed(own, "i", "near")[0].select("i", "v", F.col("near.d2").alias("ds"), F.col("near.j").alias("js"), F.pmod(F.xxhash64("i"), F.lit(nq)).cast("int").alias("qb")).withColumn("pb", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))

    def counted(q: pa.Table, p: pa.Table) -> pa.Table:
        schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("n", pa.int64())])
        if not q.num_rows or not p.num_rows:
            return schema.empty_table()
        ids, x, qi, v = p.column("id").to_numpy(), _matrix(p), q.column("i").to_numpy(), _matrix(q)
        sizes = pc.list_value_length(q.column("ds")).to_numpy()
        ends = np.cumsum(sizes)
        ds, js = (q.column(c).combine_chunks().flatten().to_numpy() for c in ("ds", "js"))
        xs, n = (x**2).sum(1), np.zeros(len(ds), np.int64)
        band = 1e-11 * max(1.0, float(xs.max()))  # the products are that near; what lies in it is measured again
        for s in range(0, len(qi), 64):
            d = (v[s : s + 64] ** 2).sum(1)[:, None] + xs[None] - 2 * v[s : s + 64] @ x.T
            d[qi[s : s + 64, None] == ids[None]] = np.inf
            for r, row in enumerate(d, s):
                for e in range(ends[r] - sizes[r], ends[r]):
                    sure = np.count_nonzero(row < ds[e] - band)
                    if np.count_nonzero(row <= ds[e] + band) > sure:
                        near = np.flatnonzero((row >= ds[e] - band) & (row <= ds[e] + band))
                        g = ((x[near] - v[r]) ** 2).sum(1)
                        sure += int(((g < ds[e] - 1e-12) | ((np.abs(g - ds[e]) <= 1e-12) & (ids[near] < js[e]))).sum())
                    n[e] = sure
        return pa.table([pa.array(np.repeat(qi, sizes)), pa.array(js), pa.array(n)], schema=schema)

    parts = lists.groupBy("qb", "pb").cogroup(held.groupBy("qb", "pb")).applyInArrow(counted, "i long, j long, n long")
    return parts.groupBy("i", "j").agg((F.sum("n") + 1).alias("rank"))


#: Samples of the target curve and the most steps of the fit.
CURVE_SAMPLES, CURVE_STEPS = 300, 100


def fit_curve(min_dist: float = 0.1, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) of 1 / (1 + a x^2b) nearest to 1 up to min_dist and exp(-(x - min_dist) / spread) beyond, over [0, 3 spread].

    Damped least squares: steps that don't lower the error are taken again with more damping."""
    x = np.linspace(0, 3 * spread, CURVE_SAMPLES)[1:]
    y = np.where(x <= min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    at, damping = np.array([1.0, 1.0]), 1e-3
    curve = lambda p: 1 / (1 + p[0] * x ** (2 * p[1]))
    error = lambda p: ((curve(p) - y) ** 2).sum()
    for _ in range(CURVE_STEPS):
        f = curve(at)
        power = x ** (2 * at[1])
        slope = np.stack([-power, -2 * at[0] * power * np.log(x)], 1) * (f * f)[:, None]
        gram = slope.T @ slope
        move = -np.linalg.solve(gram + damping * np.diag(np.diag(gram)), slope.T @ (f - y))
        if (at + move > 0).all() and error(at + move) < error(at):
            at, damping = at + move, max(damping * 0.3, 1e-12)
            if np.abs(move).sum() < 1e-12:
                break
        else:
            damping *= 10
            if damping > 1e10:
                break
    return float(at[0]), float(at[1])


def layout(edges: DataFrame, epochs: int = 200, a: float | None = None, b: float | None = None, dims: int = 2, seed: int = 42, start: DataFrame | None = None, first: int = 0) -> DataFrame:
    """Stochastic layout of a fuzzy graph: id, y. One task, as its steps follow one another; bounded by the graph's size.

    ``start``: (id, y) to begin with, scaled to +-10 if it is wider; else uniform in +-10. ``first``: the epoch to begin
    with, so that a finished layout can be warmed up again from a late one."""
    if a is None or b is None:
        a, b = fit_curve()
    known = {} if start is None else {r["id"]: r["y"] for r in start.collect()}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "j"])
        rng = np.random.Generator(np.random.PCG64(seed))
        ids, place = np.unique(np.concatenate([pdf["i"], pdf["j"]]), return_inverse=True)
        head, tail = place[: len(pdf)], place[len(pdf) :]
        w = pdf["w"].to_numpy()
        y = rng.uniform(-10, 10, (len(ids), dims))
        for n, i in enumerate(ids.tolist()):
            if i in known:
                y[n] = known[i]
        y *= min(1.0, 10 / max(1e-12, np.abs(y).max()))
        period, due = w.max() / np.maximum(w, 1e-12), w.max() / np.maximum(w, 1e-12)
        due += first
        for epoch in range(first, epochs):
            alpha = 1 - epoch / epochs
            now = np.flatnonzero(due <= epoch + 1)
            due[now] += period[now]
            gap = y[head[now]] - y[tail[now]]
            d2 = (gap**2).sum(1)
            pull = np.where(d2 > 0, -2 * a * b * np.maximum(d2, 1e-12) ** (b - 1) / (a * d2**b + 1), 0)
            step = np.clip(pull[:, None] * gap, -4, 4) * alpha
            np.add.at(y, head[now], step)
            np.add.at(y, tail[now], -step)
            for _ in range(5):
                other = rng.integers(0, len(ids), len(now))
                gap = y[head[now]] - y[other]
                d2 = (gap**2).sum(1)
                push = 2 * b / ((0.001 + d2) * (a * d2**b + 1))
                np.add.at(y, head[now], np.clip(push[:, None] * gap, -4, 4) * alpha)
        return pd.DataFrame({"id": ids, "y": list(y)})

    return edges.select(F.lit(0).alias("all"), "i", "j", "w").groupBy("all").applyInPandas(run, "id long, y array<double>")
