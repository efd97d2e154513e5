"""Near-duplicate documents by min-max hashing.

A document is its set of distinct word shingles (ASCII letters lower-cased); with fewer words than a shingle, the
whole sequence is its one shingle; without words it has none and is linked with nothing.

1. Equal sets form a class at once, known by a 128-bit digest of the whole sorted set; the smallest id stands for it
   from here on.
2. Every permutation keeps its least *and* its greatest hash, so ``permutations`` hash passes give twice as many
   signature values. Each band joins ``rows`` values of different permutations.
3. Documents that share a band are linked to the band's smallest one if 100 * |intersection| >= percent * |union|
   holds on the full sets: a star for each band, never all its pairs.
4. While a band holds several components, another of its documents becomes the centre of a star, until a round finds
   next to none. What is still apart then is settled exactly: documents are indexed by the rarest shingles of each set
   (any linked pair shares one within the first |set| - ceil(percent * |set|) + 1), their places bound the
   intersection, and the pairs of different components that may be similar are verified.
5. Components of the links, on class representatives.

With the standard figures (24 bands of 5) a pair at the threshold of 0.85 shares no band with probability 7e-7, at
0.8 with 6e-5. Chains of near copies are reached through any of their links.

Defined results: null or empty text: 0 shingles, own component. Rows that repeat an id share its component: it is
linked with whatever one of its texts is linked with. A null id: its row is returned with null component_id and kept
false. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import text_blocks as tb
from quadrille.llm.checkpoints import saved
from quadrille.llm.components import components

U = np.uint64
BANDS, ROWS = 24, 5
#: Rounds of stars end when they link fewer than one in so many of the documents still apart.
FEW = 200
PERMUTATIONS = BANDS * ROWS // 2
_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * U(2) + U(1)
_B = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, sorted distinct shingle hashes end to end, set sizes) of blocks of documents."""
    raw, offsets = tb.text_arrays(column)
    for i, j in tb.blocks(offsets, 1 << 20):
        part = tb.LOWER[raw[offsets[i] : offsets[j]]]
        starts, ends, counts = tb.word_spans(part, offsets[i : j + 1] - offsets[i])
        h = tb.word_hashes(part, starts, ends)
        full, _, wins = tb.window_hashes(h, counts, k)
        at_word, at_win = np.cumsum(counts) - counts, np.cumsum(wins) - wins
        sets = []
        for d, (n, w) in enumerate(zip(counts.tolist(), wins.tolist(), strict=True)):
            if w:
                x = np.sort(full[at_win[d] : at_win[d] + w])
                sets.append(x[np.append(True, x[1:] != x[:-1])])
            elif n:
                sets.append(tb.window_hashes(h[at_word[d] : at_word[d] + n], np.array([n]), n, seed=1 << 40)[0])
            else:
                sets.append(full[:0])
        yield i, np.concatenate(sets) if sets else full[:0], np.array([len(x) for x in sets], np.int64)


def _bands(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Band keys of the non-empty sets that start at these places: an array of documents x BANDS."""
    least, most = [], []
    for a, b in zip(_A, _B, strict=True):
        v = keys * a + b
        least.append(np.minimum.reduceat(v, at))
        most.append(np.maximum.reduceat(v, at))
    values = np.stack(least + most, 1)
    acc = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * U(0x9E3779B97F4A7C15), (len(at), BANDS)).copy()
    for r in range(ROWS):
        acc = tb.mix((acc ^ values[:, r * BANDS : (r + 1) * BANDS]) * U(0x9FB21C651E98DF25))
    return acc


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, keys, sizes in shingle_sets(batch.column(1), k):
                n, full = len(sizes), np.flatnonzero(sizes)
                at = (np.cumsum(sizes) - sizes)[full]
                s0, s1 = np.zeros(n, U), np.zeros(n, U)
                bands = pa.array([], pa.int64())
                if len(full):
                    ends = at + sizes[full]
                    digests = b"".join(hashlib.blake2b(keys[i:j].data, digest_size=16).digest() for i, j in zip(at.tolist(), ends.tolist(), strict=True))
                    s0[full], s1[full] = np.frombuffer(digests, U).reshape(-1, 2).T
                    bands = pa.array(_bands(keys, at).view(np.int64).ravel(), pa.int64())
                offsets = np.zeros(n + 1, np.int32)
                offsets[1:] = np.cumsum((sizes > 0) * BANDS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(sizes), pa.array(s0.view(np.int64)), pa.array(s1.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), bands)],
                    names=["id", "n", "s0", "s1", "bands"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, keys, sizes in shingle_sets(batch.column(1), k):
                offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sizes)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64)))], names=["id", "keys"])

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("keys").alias("ka"))
    right = sets.select(F.col("id").alias("b"), F.col("keys").alias("kb"))
    n = F.size(F.array_intersect("ka", "kb")).cast("long")
    # sizes alone rule out a pair whose smaller set is too small
    fits = 100 * F.least(F.size("ka"), F.size("kb")).cast("long") >= percent * F.greatest(F.size("ka"), F.size("kb")).cast("long")
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(fits).withColumn("n", n)
    return both.where(100 * F.col("n") >= percent * (F.size("ka") + F.size("kb") - F.col("n"))).select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, n_shingles, component_id, kept (id = component_id), n_links of its class."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch = saved(rows.mapInArrow(_sketch(k), "id long, n long, s0 long, s1 long, bands array<long>"))
    key = ["n", "s0", "s1"]
    classes = saved(sketch.where("n > 0 and id is not null").groupBy(*key).agg(F.min("id").alias("rep"), F.first("bands").alias("bands")))

    held = classes.select("rep", F.explode("bands").alias("band"))
    hubs = held.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("m")).where("m > 1").select("band", "hub")
    shared = saved(held.join(hubs.hint("merge"), "band"))  # bands of two documents or more
    stars = shared.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()

    wanted = shared.select(F.col("rep").alias("id")).distinct()
    sets = saved(rows.join(wanted.hint("merge"), "id", "left_semi").mapInArrow(_sets(k), "id long, keys array<long>").groupBy("id", F.xxhash64("keys").alias("text")).agg(F.first("keys").alias("keys")).drop("text"))
    links = saved(_linked(stars, sets, percent).unionAll(_same_id(sketch, classes)))
    label = components(links)

    tried = stars
    while True:  # stars around other documents of the bands in which some are still apart
        apart = saved(_apart(shared, label))
        more = apart.where("c <> hub_c").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()
        more = saved(more.join(tried.hint("merge"), ["a", "b"], "left_anti"))
        found = saved(_linked(more, sets, percent))
        n = found.count()
        tried, links = tried.unionAll(more), links.unionAll(found)
        if n == 0 or n * FEW < apart.count():  # the last step finds what is left; more rounds would only make it smaller
            break
        label = components(links)
    more = _by_rarest(apart.select("rep", "c").distinct(), sets, percent)
    more = saved(_linked(more.join(tried.hint("merge"), ["a", "b"], "left_anti"), sets, percent))
    links = links.unionAll(more)
    if n or not more.isEmpty():
        label = components(links)

    degree = links.distinct().select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    found = classes.join(label, classes["rep"] == label["node"], "left").drop("node").join(degree, F.col("rep") == degree["node"], "left")
    found = found.select(*[F.col(c).alias("_" + c) for c in key], F.coalesce("component", "rep").alias("component"), F.coalesce("n_links", F.lit(0)).alias("links"))
    same = (F.col("n") == F.col("_n")) & (F.col("s0") == F.col("_s0")) & (F.col("s1") == F.col("_s1"))
    # sets without shingles meet no class, and are spread by their ids
    out = sketch.select("id", "n", F.when(F.col("n") > 0, F.col("s0")).otherwise(F.xxhash64("id", F.monotonically_increasing_id())).alias("s0"), "s1").join(found, same, "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"), F.coalesce("links", F.lit(0)).alias("n_links"))


def _same_id(sketch: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that have one id and different sets."""
    several = sketch.where("n > 0 and id is not null").groupBy("id").agg(F.min(F.struct("s0", "s1")).alias("lo"), F.max(F.struct("s0", "s1")).alias("hi")).where("lo <> hi").select("id")
    held = sketch.where("n > 0").join(several, "id").select("id", "n", "s0", "s1").distinct().join(classes, ["n", "s0", "s1"]).select("id", "rep")
    return held.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))


def _apart(shared: DataFrame, label: DataFrame) -> DataFrame:
    """(band, rep, c, hub, hub_c) of the bands whose documents lie in several components, with one of their documents as hub."""
    named = shared.join(label.hint("merge"), shared["rep"] == label["node"], "left").select("band", "rep", F.coalesce("component", "rep").alias("c"))
    most = F.xxhash64("c")
    split = named.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max_by("rep", most).alias("hub"), F.max_by("c", most).alias("hub_c")).where("lo < hi").drop("lo", "hi")
    return named.join(split.hint("merge"), "band")


def _by_rarest(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a < b) of different components: every similar pair shares one of the rarest shingles of both.

    Sets are put in the order of rarity. Where both sets hold their first shared shingle, what comes before is not
    shared, so the places bound the intersection; a set with too many shingles of its own meets nobody."""
    tokens = apart.join(sets.hint("merge"), apart["rep"] == sets["id"]).select("rep", "c", F.size("keys").alias("n"), F.explode_outer("keys").alias("t"))
    df = tokens.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    # shingles of one document alone only count: they come first in its order
    ranked = tokens.join(df, "t").groupBy("rep", "c", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("ts"))
    ranked = ranked.withColumn("alone", F.col("n") - F.size("ts")).where(100 * F.size("ts").cast("long") >= percent * F.col("n").cast("long"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9).cast("int") + 1 - F.col("alone")
    heads = ranked.where(prefix > 0).select("rep", "c", "n", "alone", F.posexplode_outer(F.slice("ts", F.lit(1), prefix)).alias("i", "x"))
    heads = heads.select("rep", "c", "n", (F.col("n") - F.col("alone") - F.col("i")).alias("left"), F.col("x.t").alias("t"))
    mixed = heads.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("t")
    heads = saved(heads.join(mixed, "t"))
    other = heads.select("t", F.col("rep").alias("rep2"), F.col("c").alias("c2"), F.col("n").alias("n2"), F.col("left").alias("left2"))
    enough = (100 + percent) * F.least("left", "left2").cast("long") >= percent * (F.col("n") + F.col("n2")).cast("long")
    pairs = heads.join(other, "t").where((F.col("c") < F.col("c2")) & enough)
    return pairs.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct()
