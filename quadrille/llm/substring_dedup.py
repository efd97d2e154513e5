"""Removal of long passages that occur before, by compaction of the De Bruijn graph of words.

The windows of ``window`` consecutive words are the edges of the graph. A word goes if an edge over it has the word
sequence of an edge that starts earlier: in a smaller id, or in the same document before it. Edges are judged on the
input, not on what is left.

1. *Paths.* The edges that share their anchor, the k-mer of least hash inside them, follow each other in the text: they
   leave a document as one row, a path, with the anchor, the place and a hash of all its words. Equal edges have equal
   anchors at equal distances, so an anchor that occurs once in the corpus holds nothing that repeats, and a join with
   the repeated anchors drops its path.
2. *Branches.* Paths of equal words are one path of the graph, known by its first place. An anchor with a single such path
   does not branch there: the path stays compact, one row however many edges and copies it has. Where several different
   paths meet at an anchor, one copy of each is split into its edges, and aggregation and join give each edge's first
   place. Edges of a path that follow each other at their first places too are compacted again.
3. *Sources.* A join gives every copy of a path the first places of its parts: their sources.
4. *Spans.* Parts that follow each other in a document and in their source are glued to one long span.
5. *Verification.* The words at each span's source coordinates are read from the source's text, and the span is cut
   only if its own words have the same 128-bit digest.

No group is ever gathered: counts and first places are aggregated before the shuffle, and everything else is a join,
which adaptive execution splits where a key is hot. It can do so only between two plain shuffles, so what is joined to a
table with hot keys is stored first. What is collected for one document is bounded by its own length.

Defined results: a null text has no words. A text of fewer words than a window is kept. A null id is smaller than all
others. Rows of one id (or of none) and different texts count in the order of a hash of their texts; rows that repeat both
id and text are one document, cut alike. Extra columns are carried along whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm import text_blocks as tb
from quadrille.llm.checkpoints import dropped, stored

WINDOW, ANCHOR = 20, 6
#: Bytes of text that the Python functions take apart at once; a longer text is one block.
BLOCK = 1 << 20
U = np.uint64
_MULT = 0xD1342543DE82EF95


class Paths:
    """The paths of some documents: for each its document, first edge, edges, anchor's distance from the first edge, anchor's hash and a hash of its words."""

    def __init__(self, h: np.ndarray, counts: np.ndarray, window: int):
        k = min(ANCHOR, window)
        span = window - k + 1
        wins = np.maximum(counts - window + 1, 0)
        n = int(wins.sum())
        self.h, self.word0 = h, np.cumsum(counts) - counts
        if not n:
            empty = np.zeros(0, np.int64)
            self.doc, self.at, self.n, self.ahead, self.anchor, self.path = empty, empty, empty, empty, np.zeros(0, U), np.zeros(0, np.int32)
            return
        begin = np.repeat(self.word0 - (np.cumsum(wins) - wins), wins) + np.arange(n)
        doc = np.repeat(np.arange(len(wins)), wins)
        kmer = rolled(h, k)
        least, place = kmer, np.arange(len(kmer))
        width = 1
        while width < span:  # the first least value among `width` k-mers, for more and more of them
            step = min(width, span - width)
            left = len(least) - step
            better = least[step:] < least[:left]
            place = np.where(better, place[step:], place[:left])
            least = np.where(better, least[step:], least[:left])
            width += step
        spot = place[begin]
        new = np.ones(n, bool)
        new[1:] = (spot[1:] != spot[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        self.n = np.diff(np.append(first, n))
        self.doc, start = doc[first], begin[first]
        self.at, self.ahead, self.anchor = start - self.word0[self.doc], spot[first] - start, kmer[spot[first]]
        total = np.zeros(len(h) + 1, U)
        np.cumsum(h * powers(_MULT, len(h)), out=total[1:])
        whole = (total[start + self.n + window - 1] - total[start]) * powers(pow(_MULT, -1, 2**64), len(h))[start]
        self.path = (tb.mix(whole + (self.n * 64 + self.ahead).astype(U) * U(0x9E3779B97F4A7C15)) >> U(32)).astype(np.uint32).view(np.int32)


def powers(r: int, n: int) -> np.ndarray:
    out = np.full(n, U(r))
    out[:1] = 1
    return np.multiply.accumulate(out)


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = max(0, len(h) - k + 1)
    acc = np.full(n, U(0x8EBC6AF09C88C6E3))
    for i in range(k):
        acc = (acc ^ h[i : i + n]) * U(0x9FB21C651E98DF25)
        acc ^= acc >> U(29)
    return tb.mix(acc)


def _worded(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end, word hashes, words of each) of blocks of texts."""
    raw, offsets = tb.text_arrays(texts)
    for i, j in tb.blocks(offsets, BLOCK):
        part = raw[offsets[i] : offsets[j]]
        starts, ends, counts = tb.word_spans(part, offsets[i : j + 1] - offsets[i])
        yield i, j, tb.word_hashes(part, starts, ends), counts


def _paths(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, h, counts in _worded(b.column(2)):
                p = Paths(h, counts, window)
                at = pa.array(p.doc + i)
                columns = [b.column(0).take(at), b.column(1).take(at), pa.array(p.at.astype(np.int32)), pa.array(p.n.astype(np.int32)), pa.array(p.anchor.view(np.int64)), pa.array(p.path)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "th", "at", "n", "e0", "e1"])

    return run


def _edges(window: int):
    """Rows (id, th, text, paths: list of (at, n, e0, e1, several)) to the edges of the paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            bounds = lists.offsets.to_numpy()
            paths = lists.values.flatten()
            at, n = (x.to_numpy().astype(np.int64) for x in paths[:2])
            for i, j, h, counts in _worded(b.column(2)):
                mine = np.arange(bounds[i], bounds[j])
                edges = np.repeat(mine, n[mine])
                off = np.arange(len(edges)) - np.repeat(np.cumsum(n[mine]) - n[mine], n[mine])
                doc = np.repeat(np.repeat(np.arange(i, j), np.diff(bounds[i : j + 1])), n[mine])
                start = (np.cumsum(counts) - counts)[doc - i] + at[edges] + off
                acc = np.full(len(start), U(0x243F6A8885A308D3))
                for s in range(window):
                    acc = (acc ^ h[start + s]) * U(0x9FB21C651E98DF25)
                    acc ^= acc >> U(29)
                rows, of = pa.array(doc), pa.array(edges)
                hashes = (tb.mix(acc) >> U(32)).astype(np.uint32).view(np.int32)
                columns = [b.column(0).take(rows), b.column(1).take(rows), pa.array((at[edges] + off).astype(np.int32)), pa.array(off.astype(np.int32)), *(x.take(of) for x in paths[2:]), pa.array(hashes)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "th", "at", "off", "e0", "e1", "several", "h"])

    return run


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _digests(text_at: int):
    """Rows (id, th, row, places: list of (at, words)) to the digests of the words there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, places = b.column(2).flatten()[text_at], b.column(3).to_pylist()
            which, at, long, out = [], [], [], []
            for i, asked in enumerate(places):
                words = (texts[i].as_py() or "").encode().split()
                for x in asked:
                    which.append(i)
                    at.append(x["at"])
                    long.append(x["words"])
                    out.append(_digest(words[x["at"] : x["at"] + x["words"]]))
            rows = pa.array(which, pa.int64())
            columns = [b.column(0).take(rows), b.column(1).take(rows), pa.array(at, pa.int32()), pa.array(long, pa.int32()), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["sid", "sth", "sat", "words", "digest"])

    return run


def _gone(raw: bytes, spans) -> np.ndarray | None:
    """Which words of a text its verified spans take, or None if there are none."""
    if not spans:
        return None
    words = raw.split()
    gone = np.zeros(len(words), bool)
    for x in spans:
        a, b = x["at"], x["at"] + x["words"]
        if not gone[a:b].all() and _digest(words[a:b]) == x["digest"]:
            gone[a:b] = True
    return gone if gone.any() else None


def _cut(text_at: int, keep_layout: bool):
    """Rows (row, spans) to the row's columns with the text cut, or the hash of its kept words, then words and removed words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns, spans = b.column(0).flatten(), b.column(1).to_pylist()
            raw, offsets = tb.text_arrays(columns[text_at])
            known = columns[text_at].is_valid().to_pylist()
            texts, n, removed = [], np.concatenate([[0], *(c for _, _, _, c in _worded(columns[text_at]))])[1:], []
            for d, held in enumerate(spans):
                body = raw[offsets[d] : offsets[d + 1]].tobytes()
                gone = _gone(body, held)
                removed.append(0 if gone is None else int(gone.sum()))
                if keep_layout:
                    texts.append((body if gone is None else _without(body, gone)).decode() if known[d] else None)
                else:
                    words = body.split()
                    texts.append(hashlib.sha256(b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g])).hexdigest())
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=[f"c{i}" for i in range(len(columns))] + ["n_words", "n_removed"])

    return run


def _without(body: bytes, gone: np.ndarray) -> bytes:
    """The text without its removed words, nor the white space after each; the rest as it stood."""
    raw = np.frombuffer(body, np.uint8)
    starts, _, _ = tb.word_spans(raw, np.array([0, len(raw)]))
    owner = np.append(starts, len(raw))
    keep = np.ones(len(raw), bool)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        keep[owner[a] : owner[b]] = False
    return raw[keep].tobytes()


def _same(a: str, b: str):
    """That two sides of a join mean one document."""
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))


def _keyed(rows: DataFrame, text: str) -> DataFrame:
    """Adds th, which with the id makes the key of a document: 0, or a hash of the text where the id is null or repeats."""
    several = stored(rows.where("id is not null").groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("_m")).where("_m > 1"))
    return rows.join(several, rows["id"] == several["_id"], "left").withColumn("th", F.when(F.col("id").isNull() | F.col("_m").isNotNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))).drop("_id", "_m")


def spans(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Repeated spans of (id, th, text): id, th, at, words, and their sources sid, sth, sat. Not verified yet."""
    kind = texts.schema["id"].dataType.simpleString()
    paths = stored(texts.mapInArrow(_paths(window), f"id {kind}, th long, at int, n int, e0 long, e1 int"))
    anchors = stored(paths.groupBy("e0").agg(F.count("*").alias("m")).where("m > 1").select("e0"))
    copies = stored(paths.join(anchors, "e0"))
    dropped(paths)

    place = F.struct("id", "th", "at")
    known = copies.groupBy("e0", "e1").agg(F.max("n").alias("n"), F.min(place).alias("src"), F.max(place).alias("last"))
    known = stored(known.select("e0", "e1", "n", "src", (F.col("src") != F.col("last")).alias("several")))
    branch = stored(known.groupBy("e0").agg(F.count("*").alias("m")).where("m > 1").select("e0"))
    plain = known.where("several").join(branch, "e0", "left_anti").select("e0", "e1", F.array(F.struct(F.lit(0).alias("off"), "n", "src")).alias("parts"))

    split = known.join(branch, "e0").select("src.id", "src.th", F.struct("src.at", "n", "e0", "e1", "several").alias("path")).groupBy("id", "th").agg(F.collect_list("path").alias("paths"))
    split = stored(split)
    edges = texts.alias("t").join(split.alias("p"), _same("t", "p")).select("t.id", "t.th", "t.text", "p.paths")
    edges = stored(edges.mapInArrow(_edges(window), f"id {kind}, th long, at int, off int, e0 long, e1 int, several boolean, h int"))
    first = edges.groupBy("e0", "h").agg(F.min(place).alias("src"), F.max(place).alias("last")).where("src <> last").select("e0", "h", "src")
    first = stored(first)
    held = edges.withColumn("own", place).join(first, ["e0", "h"], "left").withColumn("src", F.coalesce("src", "own")).where("several or src <> own")
    held = held.groupBy("e0", "e1").agg(F.array_sort(F.collect_set(F.struct("off", "src"))).alias("x"))
    follows = "x[i].off = x[i - 1].off + 1 and x[i].src.id <=> x[i - 1].src.id and x[i].src.th = x[i - 1].src.th and x[i].src.at = x[i - 1].src.at + 1"
    held = held.withColumn("i", F.expr(f"filter(sequence(0, size(x) - 1), i -> i = 0 or not ({follows}))"))
    parts = held.select("e0", "e1", F.expr("transform(i, (a, k) -> struct(x[a].off as off, coalesce(get(i, k + 1), size(x)) - a as n, x[a].src as src))").alias("parts"))

    found = copies.select("id", "th", "at", "e0", "e1").join(plain.unionAll(parts), ["e0", "e1"]).select("id", "th", "at", F.explode("parts").alias("p"))
    found = found.select("id", "th", (F.col("at") + F.col("p.off")).alias("at"), "p.n", "p.src").where(place != F.col("src"))
    along = Window.partitionBy("id", "th").orderBy("at")
    shift = F.col("at") - F.col("src.at")
    same = (F.lag("src.id").over(along).eqNullSafe(F.col("src.id"))) & (F.lag("src.th").over(along) == F.col("src.th")) & (F.lag(shift).over(along) == shift) & (F.lag(F.col("at") + F.col("n")).over(along) >= F.col("at"))
    glued = found.withColumn("island", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("island").over(along))
    glued = glued.groupBy("id", "th", "island").agg(F.min("at").alias("at"), F.max(F.col("at") + F.col("n")).alias("end"), F.min("src").alias("src"))
    return stored(glued.select("id", "th", "at", (F.col("end") - F.col("at") + window - 1).cast("int").alias("words"), F.col("src.id").alias("sid"), F.col("src.th").alias("sth"), F.col("src.at").alias("sat")))


def _run(docs: DataFrame, id_col: str, text_col: str, window: int, keep_layout: bool) -> DataFrame:
    fields = docs.schema.fields
    names = [f"c{i}" for i in range(len(fields))]
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    plain = docs.toDF(*names).withColumn(names[text_at], F.col(names[text_at]).cast("string"))
    rows = _keyed(plain.select(F.col(names[id_at]).alias("id"), F.struct(*names).alias("row")), f"row.{names[text_at]}")
    found = spans(rows.select("id", "th", F.col(f"row.{names[text_at]}").alias("text")), window)

    # the source's words, read at the coordinates; then each span with their digest goes to its own text
    asked = stored(found.select(F.col("sid").alias("id"), F.col("sth").alias("th"), F.struct(F.col("sat").alias("at"), "words").alias("place")).groupBy("id", "th").agg(F.collect_set("place").alias("places")))
    kind = docs.schema[id_col].dataType.simpleString()
    read = rows.alias("t").join(asked.alias("a"), _same("t", "a")).select("t.id", "t.th", "t.row", "a.places").mapInArrow(_digests(text_at), f"sid {kind}, sth long, sat int, words int, digest binary")
    read = stored(read.distinct())
    source = F.col("f.sid").eqNullSafe(F.col("d.sid")) & (F.col("f.sth") == F.col("d.sth")) & (F.col("f.sat") == F.col("d.sat")) & (F.col("f.words") == F.col("d.words"))
    checked = found.alias("f").join(read.alias("d"), source).groupBy("f.id", "f.th").agg(F.collect_set(F.struct("f.at", "f.words", "d.digest")).alias("spans"))
    checked = stored(checked)
    out = T.StructType([T.StructField(f"c{i}", T.StringType() if i == text_at else f.dataType) for i, f in enumerate(fields)] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return rows.alias("t").join(checked.alias("c"), _same("t", "c"), "left").select("t.row", "c.spans").mapInArrow(_cut(text_at, keep_layout), out)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated words cut from the text and all else as it stood, then n_words (before) and n_removed.

    A removed word takes the white space after it along. If the input has columns of these names, use ``passages``."""
    return _run(docs, id_col, text_col, window, True).toDF(*docs.columns, "n_words", "n_removed")


def passages(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, n_removed, kept_sha256 of the kept words joined by one space."""
    return _run(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col, window, False).select(F.col("c0").alias(id_col), "n_words", "n_removed", F.col("c1").alias("kept_sha256"))
