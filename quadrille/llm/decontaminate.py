"""Passages of benchmark items in documents, in DataFrame operations only.

Words are lower-cased, shingles are ``k`` consecutive words, and a passage is a window of as many words as the item
(the whole document if it is shorter). A window matches an item if the weighted similarity of their shingles
(sum of the smaller counts over sum of the larger) is at least ``similarity``.

1. Shingles of all documents are looked up among the items'. A window that matches holds at least
   ceil(similarity * shingles of the item) of them, and moving a matching window up to its first shared shingle
   never makes it worse, so only windows that begin at a shared shingle (or end with the document) and hold
   enough of them are taken: nothing similar is lost.
2. Each such window and each item has a 64-bit SimHash of its shingles. The bits are cut into ``RADIUS`` + 1 blocks of
   eight bits; two fingerprints within ``RADIUS`` bits agree in one block at least, so an equi-join on (words, block,
   bits) finds all of them, and brings 3 % of the pairs of one length together by chance.
3. Shingles at similarity 0.8 differ in 10 of 64 bits on average, so a radius with selective blocks is not enough for
   what is least similar. Pairs beyond it are not lost: a window is also paired with the items of step 1 whose
   fingerprints are farther.
4. The pairs found are verified by the exact weighted similarity.

An item of fewer than ``k`` words has no shingle; it is found where its whole word sequence stands. Items of equal word
sequences are looked for once. Null or empty texts match nothing; equal rows are found alike. Rows with one id (or none)
and different texts are searched apart and reported under the id; ``clean`` drops only those of them that hold an item.
The items' shingles are broadcast while they are at most ``BROADCAST_SHINGLES``, else joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.checkpoints import saved

RADIUS = 7
BROADCAST_SHINGLES = 1 << 20
_EDGES = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]


def shingled(rows: DataFrame, k: int, whole: bool = False) -> DataFrame:
    """Adds n (words) and sh (hashes of all shingles in order, empty if too short) to rows with a text.

    whole: a text of fewer than k words has the hash of its word sequence as only one.

    Explode sh only by the outer forms, and don't filter on it: the optimizer would push ``size(sh) > 0`` below
    the split and repeat the split for every word."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("w", words)
    every = f"transform(sequence(0, size(w) - {k}), i -> xxhash64({', '.join(f'get(w, i + {j})' for j in range(k))}))"
    short = F.array().cast("array<bigint>")
    for n in range(1, k) if whole else ():
        short = F.when(F.size("w") == n, F.array(F.expr(f"xxhash64({', '.join(f'get(w, {j})' for j in range(n))})"))).otherwise(short)
    return rows.withColumns({"n": F.size("w"), "sh": F.when(F.size("w") >= k, F.expr(every)).otherwise(short)}).drop("w", "text")


def simhash(column: str) -> str:
    """SQL of the 64-bit SimHash of an array of hashes, each counted as often as it stands there."""
    return f"aggregate(sequence(0, 63), 0L, (f, b) -> f | if(aggregate({column}, 0, (s, h) -> s + cast(2 * (shiftright(h, b) & 1L) - 1 as int)) > 0, shiftleft(1L, b), 0L))"


def _blocks(fingerprint: str) -> str:
    """SQL of the array of (block, its bits)."""
    return "array(" + ", ".join(f"struct({i} as block, shiftrightunsigned({fingerprint}, {a}) & {(1 << (b - a)) - 1}L as bits)" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:], strict=False))) + ")"


def _similarity(a: str, b: str) -> str:
    """SQL of the weighted similarity of two arrays of hashes."""
    shared = f"aggregate(array_intersect({a}, {b}), 0, (s, x) -> s + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))"
    return f"transform(array({shared}), x -> x / cast(size({a}) + size({b}) - x as double))[0]"


def found(docs: DataFrame, items: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per distinct text of an id, item and matching window: doc, mark (hash of the text), item, s (first word), similarity."""
    named = shingled(items.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")), k, whole=True)
    named = saved(named.where("n > 0").withColumn("class", F.xxhash64("n", "sh")))
    # equal items are one class
    bench = saved(named.groupBy("class", "n").agg(F.first("sh").alias("sh")))
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    # a row is known by its id and its text, so that rows sharing an id stay apart
    rows = rows.withColumn("mark", F.xxhash64("text"))
    pairs = _similar(rows, bench.where(F.col("n") >= k), k, similarity)
    for n in [r[0] for r in bench.where(F.col("n") < k).select("n").distinct().orderBy("n").collect()]:  # k - 1 at most
        short = bench.where(F.col("n") == n).select("class", F.col("sh")[0].alias("h"))
        short = F.broadcast(short) if short.count() <= BROADCAST_SHINGLES else short
        held = shingled(rows, n).select("doc", "mark", F.posexplode_outer("sh").alias("s", "h")).join(short, "h")
        pairs = pairs.unionAll(held.select("doc", "mark", "class", "s", F.lit(1.0).alias("similarity")).distinct())
    return pairs.join(named.select("class", "item"), "class").drop("class")


def _similar(rows: DataFrame, bench: DataFrame, k: int, similarity: float) -> DataFrame:
    """(doc, mark, class, s, similarity) of the windows that match an item of k words or more."""
    known = bench.select("class", "n", F.size("sh").alias("m"), F.explode("sh").alias("h")).distinct()
    size = known.count()
    common = known.select("h").distinct()
    common = F.broadcast(common) if size <= BROADCAST_SHINGLES else common

    marks = shingled(rows, k).select("doc", "mark", F.col("n").alias("dn"), F.posexplode_outer("sh").alias("p", "h"))
    hits = saved(marks.join(common, "h").distinct())
    need = F.ceil(F.col("m") * similarity - 1e-9).cast("int")
    held = hits.join(known.withColumnRenamed("n", "words"), "h").groupBy("doc", "mark", "dn", "words", "class", "m").agg(F.array_sort(F.collect_set("p")).alias("ps")).withColumn("need", need)
    held = held.where(F.size("ps") >= F.col("need"))
    # windows that begin at a shared shingle and hold enough of them; ends of documents are the last begin
    begin = "greatest(0, least(ps[i], dn - words))"
    enough = "filter(sequence(0, size(ps) - need), i -> ps[i + need - 1] - ps[i] < m)"
    tail = "if(size(filter(ps, p -> p >= greatest(0, dn - words))) >= need, array(greatest(0, dn - words)), array())"
    begins = f"array_distinct(concat(transform({enough}, i -> {begin}), {tail}))"
    windows = held.withColumn("s", F.explode(F.expr(begins))).groupBy("doc", "mark", "words", "m", "s").agg(F.collect_set("class").alias("classes"))

    wanted = held.select("doc", "mark").distinct()
    near = rows.join(wanted.withColumnRenamed("doc", "_d").withColumnRenamed("mark", "_m"), F.col("doc").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m")), "left_semi")
    near = shingled(near, k).groupBy("doc", "mark").agg(F.first("sh").alias("all"))
    w, t = windows.alias("w"), near.alias("t")
    cut = w.join(t, F.col("w.doc").eqNullSafe(F.col("t.doc")) & (F.col("w.mark") == F.col("t.mark"))).select("w.doc", "w.mark", "w.words", "w.s", "w.classes", F.expr("slice(all, s + 1, m)").alias("sh"))
    prints = saved(cut.withColumn("f", F.expr(simhash("sh"))))
    index = saved(bench.select("class", F.col("n").alias("words"), F.col("sh").alias("ish"), F.expr(simhash("sh")).alias("g")))
    apart = F.bit_count(F.col("f").bitwiseXOR(F.col("g")))
    left = prints.withColumn("x", F.explode(F.expr(_blocks("f")))).select("doc", "mark", "words", "s", "sh", "f", "x.block", "x.bits")
    right = index.withColumn("x", F.explode(F.expr(_blocks("g")))).select("class", "words", "ish", "g", "x.block", "x.bits")
    # a pair found in several blocks is verified in the first of them
    first = f"block = array_min(transform(filter(arrays_zip({_blocks('f')}, {_blocks('g')}), z -> z['0'].bits = z['1'].bits), z -> z['0'].block))"
    close = left.join(right, ["words", "block", "bits"]).where(apart <= RADIUS).where(F.expr(first))
    far = prints.withColumn("class", F.explode("classes")).join(index.drop("words"), "class").where(apart > RADIUS)
    columns = ["doc", "mark", "class", "s", "sh", "ish"]
    both = close.select(*columns).unionAll(far.select(*columns))
    return both.withColumn("similarity", F.expr(_similarity("sh", "ish"))).where(F.col("similarity") >= similarity).drop("sh", "ish")


def contaminated(docs: DataFrame, items: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item found in it: the ids, similarity (of the best window), first_word (its place), n_windows."""
    pairs = found(docs, items, k, similarity, id_col, text_col, item_col, item_text_col)
    return pairs.groupBy(F.col("doc").alias(id_col), F.col("item").alias(item_col)).agg(F.max("similarity").alias("similarity"), F.min_by("s", F.struct(-F.col("similarity"), F.col("s"))).alias("first_word"), F.count("*").alias("n_windows"))


def clean(docs: DataFrame, items: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those in which an item was found, null ids included."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    own, text = plain[names[docs.columns.index(id_col)]], plain[names[docs.columns.index(text_col)]]
    bad = found(docs, items, k, similarity, id_col, text_col).select("doc", "mark").distinct()
    return plain.join(bad, own.eqNullSafe(bad["doc"]) & (F.xxhash64(text.cast("string")) == bad["mark"]), "left_anti").toDF(*docs.columns)
