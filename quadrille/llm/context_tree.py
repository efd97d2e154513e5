"""Language-model scores by context-tree weighting over bytes.

A text is its words (ASCII letters lower-cased) with one space between them and one end mark (byte 10, which no word
holds). Each byte is coded as eight binary decisions; each decision has a Krichevsky-Trofimov estimate at every context
of 0 to ``depth`` bytes, and the estimates of all depths are mixed by their context-tree weights: at a context s,
P_w(s) = P_e(s)/2 + (product of P_w over the longer contexts below s)/2. The counts are those of all training texts;
a text's probability mixes, along its contexts, from the longest one that training has seen. The score is log10 of it.

Nothing is sampled, and no task holds the whole model:

1. *Questions.* Texts are dealt into chunks. A chunk asks about its distinct (context, byte) pairs, with their counts in
   its training texts, and about its distinct words. Pairs are dealt by the last two bytes of the context, each such
   context spread over ``SPREAD`` ranges by the third byte, so all longer contexts of one range are complete there.
2. *Tops.* Ranges sum up their contexts of two bytes. These sums, at most 255 * 65,536 rows however large the corpus,
   are added up by Spark and sent to all ranges: contexts of fewer than three bytes.
3. *Answers.* A range weighs its trees and gives each pair asked its log-probability, each word its training count.

The base score is the unigram word model with add-half smoothing over the training words.

Defined results: a null or empty text is the end mark alone. Rows that repeat get equal scores. Without training texts
every binary decision has probability 1/2. A null id counts as a training text of the chunk of nulls.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm import chunks as ch
from quadrille.llm import text_blocks as tb
from quadrille.llm.checkpoints import saved

DEPTH = 5
TOP = 2
SPREAD = 16
CHUNK_BYTES = 20 << 20
U = np.uint64
_END = U(0x6A09E667F3BCC909)
_HALF = 0.5 * np.log(np.pi)
_SMALL = 4096


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 8, by Stirling's series."""
    r = 1.0 / x
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + r * (1 / 12 - r * r * (1 / 360 - r * r / 1260))


def _cumulated(start: float, first: float) -> np.ndarray:
    return np.concatenate([[start], start + np.cumsum(np.log(first + np.arange(_SMALL - 1)))])


_HALVES = _cumulated(_HALF, 0.5)  # log Gamma(k + 1/2)
_WHOLE = _cumulated(0.0, 1.0)  # log Gamma(k + 1)


def _log_gamma(k: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    out = table[np.minimum(k, _SMALL - 1)]
    big = k >= _SMALL
    if big.any():
        out = out.copy()
        out[big] = _lgamma(k[big] + shift)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _log_gamma(zeros, _HALVES, 0.5) + _log_gamma(ones, _HALVES, 0.5) - 2 * _HALF - _log_gamma(zeros + ones, _WHOLE, 1.0)


def streams(raw: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes: for each document ``depth`` zeros, its words with single spaces, the end mark; each document's start; its coded bytes).

    ``raw`` is lower-cased already."""
    starts, ends, counts = tb.word_spans(raw, offsets)
    docs = len(counts)
    letters = np.zeros(len(raw) + 1, np.int64)
    np.add.at(letters, starts, 1)
    np.subtract.at(letters, ends, 1)
    inside = np.cumsum(letters[:-1]) > 0
    full = counts > 0
    per_doc = np.diff(np.concatenate([[0], np.cumsum(inside)])[offsets]) if len(raw) else np.zeros(docs, np.int64)
    coded = per_doc + np.maximum(counts - 1, 0) + 1
    begin = np.cumsum(coded + depth) - (coded + depth)
    out = np.zeros(int((coded + depth).sum()), np.uint8)
    if len(starts):
        word_len = ends - starts
        first = np.cumsum(counts) - counts
        head = np.zeros(len(starts), bool)
        head[first[full]] = True
        gap = np.where(head, 0, 1)  # a space before all but a document's first word
        base = np.repeat(begin + depth, counts)
        run = np.cumsum(word_len + gap)
        before = np.repeat(np.concatenate([[0], run])[first], counts)
        to = base + run - word_len - before
        out[to[~head] - 1] = 32
        out[np.repeat(to - (np.cumsum(word_len) - word_len), word_len) + np.arange(int(word_len.sum()))] = raw[inside]
    out[begin + depth + coded - 1] = 10
    return out, begin, coded


def pair_keys(stream: np.ndarray, begin: np.ndarray, coded: np.ndarray, depth: int) -> np.ndarray:
    """One key for each coded byte: its context, the latest byte first, then the byte."""
    at = np.ones(len(stream), bool)
    for k in range(depth):
        at[begin + k] = False
    whole = np.concatenate([np.zeros(8, np.uint8), stream])
    latest = np.ndarray((len(stream),), "<u8", whole.data, strides=(1,))  # eight bytes up to the one before
    return ((latest >> U(8 * (8 - depth)) << U(8)) | stream)[at]


class _Level:
    """Binary decisions at contexts of one length: pairs, and for each of the eight bits its nodes."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, self.n = keys, n
        self.node: list[np.ndarray] = []
        self.first: list[np.ndarray] = []
        self.seen: list[np.ndarray] = []
        self.one: list[np.ndarray] = []
        self.weight: list[np.ndarray] = []
        self.log_pw: list[np.ndarray] = []

    def build(self, below: list[np.ndarray] | None) -> _Level:
        """below: for each bit the sums of log P_w over the next longer contexts, by node; None at full depth."""
        for b in range(8):
            prefix = self.keys >> U(8 - b)
            new = np.ones(len(prefix), bool)
            new[1:] = prefix[1:] != prefix[:-1]
            first = np.flatnonzero(new)
            bit = (self.keys >> U(7 - b)) & U(1) == 1
            every = np.add.reduceat(self.n, first) if len(first) else self.n[:0]
            ones = np.add.reduceat(self.n * bit, first) if len(first) else self.n[:0]
            log_pe = log_kt(every - ones, ones)
            self.node.append(np.cumsum(new) - 1)
            self.first.append(first)
            self.seen.append(every > 0)
            self.one.append((ones + 0.5) / (every + 1.0))
            if below is None:
                self.weight.append(np.ones(len(first)))
                self.log_pw.append(log_pe)
            else:
                most = np.maximum(log_pe, below[b])
                log_pw = most + np.log(0.5 * np.exp(log_pe - most) + 0.5 * np.exp(below[b] - most))
                self.weight.append(0.5 * np.exp(np.minimum(log_pe - log_pw, 0.6931471805599453)))
                self.log_pw.append(log_pw)
        return self

    def shorter(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of the next shorter contexts: (keys, counts, place of each of this level's pairs)."""
        keys, up = np.unique((self.keys >> U(16) << U(8)) | (self.keys & U(255)), return_inverse=True)
        return keys, np.bincount(up, self.n, len(keys)).astype(np.int64), up

    def sums_for(self, above: _Level | None, up: np.ndarray, nodes: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """Sums of log P_w by the nodes of the level above."""
        out = []
        for b in range(8):
            place = nodes[b] if nodes is not None else above.node[b]
            out.append(np.bincount(place[up[self.first[b]]], self.log_pw[b], int(place[-1]) + 1 if len(place) else 0))
        return out


def _nodes(keys: np.ndarray) -> list[np.ndarray]:
    out = []
    for b in range(8):
        prefix = keys >> U(8 - b)
        out.append(np.concatenate([[0], np.cumsum(prefix[1:] != prefix[:-1])]) if len(prefix) else np.zeros(0, np.int64))
    return out


def _tree(keys: np.ndarray, n: np.ndarray, depth: int, low: int) -> tuple[list[_Level], list[np.ndarray], _Level, list[np.ndarray]]:
    """Levels depth..low+1 (deepest first), the maps from each to the next shorter, the pairs at ``low`` and the sums for their nodes."""
    levels, ups, sums = [_Level(keys, n).build(None)], [], []
    for d in range(depth - 1, low - 1, -1):
        k, m, up = levels[-1].shorter()
        nodes = _nodes(k)
        sums = levels[-1].sums_for(None, up, nodes)
        ups.append(up)
        if d == low:
            return levels, ups, _Level(k, m), sums
        levels.append(_Level(k, m).build(sums))
    raise ValueError("depth must be more than low")


class Tops:
    """The contexts of at most TOP bytes, weighted; the same on all tasks."""

    def __init__(self, table: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        """table: bit: (node keys ascending, zeros, ones, sums of log P_w below) of the contexts of TOP bytes."""
        self.levels = []  # of TOP, TOP - 1, .., 0 bytes: for each bit (node keys, probability of a one, weight)
        now = table
        for d in range(TOP, -1, -1):
            level, after = [], {}
            for b in range(8):
                keys, zeros, ones, below = now[b]
                pe = log_kt(zeros, ones)
                most = np.maximum(pe, below)
                pw = most + np.log(0.5 * np.exp(pe - most) + 0.5 * np.exp(below - most))
                level.append((keys, (ones + 0.5) / (zeros + ones + 1.0), 0.5 * np.exp(np.minimum(pe - pw, 0.6931471805599453))))
                if d:
                    short = (keys >> U(8 + b) << U(b)) | (keys & U((1 << b) - 1))
                    k, up = np.unique(short, return_inverse=True)
                    after[b] = (k, np.bincount(up, zeros, len(k)).astype(np.int64), np.bincount(up, ones, len(k)).astype(np.int64), np.bincount(up, pw, len(k)))
            self.levels.append(level)
            now = after

    def mixed(self, keys: np.ndarray, b: int, bit: np.ndarray, p: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Goes on from p (where known) through the contexts of TOP bytes and fewer of the pairs (keys of TOP bytes)."""
        known = known.copy()
        for d, level in zip(range(TOP, -1, -1), self.levels, strict=True):
            own = ((keys >> U(8 + 8 * (TOP - d)) << U(8)) | (keys & U(255))) >> U(8 - b)
            have, one, weight = level[b]
            place = np.minimum(np.searchsorted(have, own), max(0, len(have) - 1))
            found = have[place] == own if len(have) else np.zeros(len(own), bool)
            if not found.any():
                continue
            q = np.where(bit, one[place], 1 - one[place]) if len(have) else p
            w = np.where(known, weight[place], 1.0)
            p = np.where(found, w * q + (1 - w) * p, p)
            known |= found
        return p


def _log10(keys: np.ndarray, n: np.ndarray, depth: int, tops: Tops) -> np.ndarray:
    """log10 probability of each pair's byte in its context. Keys ascend."""
    levels, ups, low, _ = _tree(keys, n, depth, TOP)
    low_of = np.arange(len(keys))
    for up in ups:
        low_of = up[low_of]
    out = np.zeros(len(keys))
    for b in range(8):
        bit = (keys >> U(7 - b)) & U(1) == 1
        p, known = np.full(len(keys), 0.5), np.zeros(len(keys), bool)
        at = np.arange(len(keys))
        for level, up in zip(levels, ups, strict=True):
            node = level.node[b][at]
            one = level.one[b][node]
            w = np.where(known, level.weight[b][node], 1.0)
            seen = level.seen[b][node]
            p = np.where(seen, w * np.where(bit, one, 1 - one) + (1 - w) * p, p)
            known |= seen
            at = up[at]
        out += np.log10(tops.mixed(low.keys[low_of], b, bit, p, known))
    return out


def _part_of(keys: np.ndarray, depth: int, parts: int) -> np.ndarray:
    """Range of each pair: by the last two bytes of its context, spread by the third."""
    two = tb.mix(keys >> U(8 * (depth + 1) - 16))
    three = tb.mix((keys >> U(8 * (depth + 1) - 24)) + U(0x51ED2701))
    return ((two % U(parts) + three % U(SPREAD)) % U(parts)).astype(np.int64)


def _counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their weights."""
    if not len(keys):
        return keys, weights.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[new], np.add.reduceat(weights.astype(np.int64), new)


def _coded_blocks(texts, depth: int):
    """(first document, keys, coded bytes of each) of blocks of documents."""
    raw, offsets = tb.text_arrays(texts)
    for i, j in tb.blocks(offsets):
        part = tb.LOWER[raw[offsets[i] : offsets[j]]]
        stream, begin, coded = streams(part, offsets[i : j + 1] - offsets[i], depth)
        yield i, pair_keys(stream, begin, coded, depth), coded


def _chunk_pairs(texts, train: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    keys, n = [], []
    for i, k, coded in _coded_blocks(texts, depth):
        marked = np.sort(k << U(1) | np.repeat(train[i : i + len(coded)], coded).astype(U))
        new = np.flatnonzero(np.append(True, marked[1:] != marked[:-1])) if len(marked) else np.zeros(0, np.int64)
        times = np.diff(np.append(new, len(marked)))
        keys.append(marked[new] >> U(1))
        n.append(times * (marked[new] & U(1)).astype(np.int64))
    return _counted(np.concatenate(keys), np.concatenate(n)) if keys else (np.zeros(0, U), np.zeros(0, np.int64))


def _body(*columns: np.ndarray) -> bytes:
    raw = ch.pack(*columns)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _columns(body: bytes, *kinds) -> list[np.ndarray]:
    return ch.unpack(pa.decompress(body[8:], int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True), *kinds)


def _sorted_parts(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _word_counts(texts, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, words of each document, distinct hashes with the end token, their training counts)."""
    h, _, counts = ch.words_of(texts, lower=True)
    every = np.append(h, np.full(len(train), _END))
    keys, n = _counted(every, np.append(np.repeat(train, counts), train).astype(np.int64))
    return h, counts, keys, n


def _ask(depth: int, parts: int):
    def ask(docs: pa.Table) -> pa.Table:
        chunk = docs.column(3)[0].as_py()
        train = docs.column(2).to_numpy(zero_copy_only=False).astype(bool)
        keys, n = _chunk_pairs(docs.column(1), train, depth)
        order, cut = _sorted_parts(_part_of(keys, depth, parts), parts)
        rows = [(p, chunk, 1, _body(keys[order[a:b]], n[order[a:b]].astype(np.uint32))) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        _, _, words, n = _word_counts(docs.column(1), train)
        cut = ch.bounds(words, parts)
        rows += [(p, chunk, 2, _body(words[a:b], n[a:b].astype(np.uint32))) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        return ch.requests(rows)

    return ask


def _merged(table: pa.Table, kind: int) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray]:
    """(rows of the kind, their keys, distinct keys, training counts)."""
    kinds = table.column("kind").to_pylist()
    rows = [i for i, k in enumerate(kinds) if k == kind]
    bodies = [_columns(table.column("body")[i].as_py(), U, np.uint32) for i in rows]
    keys, n = _counted(np.concatenate([b[0] for b in bodies]), np.concatenate([b[1] for b in bodies])) if bodies else (np.zeros(0, U), np.zeros(0, np.int64))
    return rows, [b[0] for b in bodies], keys, n


_SUMS = "bit int, node long, zeros long, ones long, below double"


def _sum_up(depth: int):
    def sums(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        _, _, keys, n = _merged(table, 1)
        trained = n > 0
        if trained.any():
            _, _, low, below = _tree(keys[trained], n[trained], depth, TOP)
            for b in range(8):
                prefix = low.keys >> U(8 - b)
                first = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
                every = np.add.reduceat(low.n, first)
                ones = np.add.reduceat(low.n * ((low.keys >> U(7 - b)) & U(1) == 1), first)
                out.append((np.full(len(first), b, np.int32), prefix[first].astype(np.int64), every - ones, ones, below[b]))
        _, _, _, n = _merged(table, 2)
        out.append((np.array([8], np.int32), np.zeros(1, np.int64), np.array([int((n > 0).sum())]), np.array([int(n.sum())]), np.zeros(1)))
        return pa.table([pa.array(np.concatenate([x[i] for x in out])) for i in range(5)], names=["bit", "node", "zeros", "ones", "below"])

    return sums


def _answer(depth: int, tops: Tops):
    def answer(table: pa.Table) -> pa.Table:
        bodies: dict[int, bytes] = {}
        rows, asked, keys, n = _merged(table, 1)
        if len(keys):
            said = _log10(keys, n, depth, tops).astype(np.float32)
            bodies |= {i: said[np.searchsorted(keys, k)].tobytes() for i, k in zip(rows, asked, strict=True)}
        rows, asked, keys, n = _merged(table, 2)
        bodies |= {i: pa.compress(n[np.searchsorted(keys, k)].astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True) for i, k in zip(rows, asked, strict=True)}
        return table.set_column(3, "body", pa.array([bodies[i] for i in range(table.num_rows)], pa.binary()))

    return answer


def _score(depth: int, parts: int, log10_all: float, kind: pa.DataType):
    schema = pa.schema([("id", kind), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_coded", pa.int64())])

    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        train = docs.column(2).to_numpy(zero_copy_only=False).astype(bool)
        got = {(k, p): b for p, k, b in zip(answers.column("part").to_pylist(), answers.column("kind").to_pylist(), answers.column("body").to_pylist(), strict=True)}
        keys, _ = _chunk_pairs(docs.column(1), train, depth)
        order, cut = _sorted_parts(_part_of(keys, depth, parts), parts)
        logs = np.zeros(len(keys), np.float64)
        for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if b > a:
                logs[order[a:b]] = np.frombuffer(got[1, p], np.float32)
        total, coded_of = np.zeros(docs.num_rows), np.zeros(docs.num_rows, np.int64)
        for i, k, coded in _coded_blocks(docs.column(1), depth):
            codes, distinct = pd.factorize(k)
            x = logs[np.searchsorted(keys, distinct)][codes]
            total[i : i + len(coded)] = np.add.reduceat(x, np.cumsum(coded) - coded)
            coded_of[i : i + len(coded)] = coded
        h, counts, words, _ = _word_counts(docs.column(1), train)
        cut = ch.bounds(words, parts)
        c = np.zeros(len(words), np.int64)
        for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if b > a:
                planes = np.frombuffer(pa.decompress(got[2, p], 8 * int(b - a), codec="zstd", asbytes=True), np.uint8)
                c[a:b] = np.ascontiguousarray(planes.reshape(8, -1).T).view(np.int64).reshape(-1)
        end = c[np.searchsorted(words, _END)]
        codes, distinct = pd.factorize(h)
        mine = c[np.searchsorted(words, distinct)][codes] if len(h) else np.zeros(0, np.int64)
        first = np.cumsum(counts) - counts
        summed = lambda v: np.add.reduceat(np.append(v, v.dtype.type(0)), first) * (counts > 0)
        n = counts + 1
        known = summed((mine > 0).astype(np.int64)) + int(end > 0)
        base = summed(np.log10(mine + 0.5)) + np.log10(end + 0.5) - n * log10_all
        return pa.table([docs.column(0), docs.column(2), pa.array(n), pa.array(known), pa.array(base), pa.array(total), pa.array(coded_of)], schema=schema)

    return score


def scores(docs: DataFrame, training: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row: its id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``training`` makes of the id column whether a text is learned from. ``depth``: bytes of the longest context, 3 to 6."""
    from pyspark.sql.pandas.types import to_arrow_type

    if not TOP < depth < 7:
        raise ValueError("depth must be from 3 to 6")
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(training(F.col(id_col)), F.lit(True)).alias("train"))
    parts = ch.chunk_count(rows, "text", chunk_bytes)
    held = ch.dealt(rows, "id", parts)
    asked = saved(held.groupBy("chunk").applyInArrow(_ask(depth, parts), ch.REQUEST).repartition(parts, "part"))
    sums = asked.groupBy("part").applyInArrow(_sum_up(depth), _SUMS).groupBy("bit", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")])
    found = sums.orderBy("bit", "node").toArrow()
    bit, node, zeros, ones, below = (found.column(c).to_numpy() for c in ("bit", "node", "zeros", "ones", "below"))
    table = {b: (node[bit == b].astype(U), zeros[bit == b], ones[bit == b], below[bit == b]) for b in range(8)}
    distinct, train_tokens = int(zeros[bit == 8].sum()), int(ones[bit == 8].sum())
    tops = Tops(table)
    said = asked.groupBy("part").applyInArrow(_answer(depth, tops), ch.REQUEST)
    score = _score(depth, parts, float(np.log10(train_tokens + 0.5 * (distinct + 1))), to_arrow_type(kind))
    out = held.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(score, f"id {kind.simpleString()}, train boolean, n_tokens long, n_known long, base_score double, score double, n_coded long")
    return out.select(F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score", (-F.col("score") * float(np.log2(10)) / F.col("n_coded")).alias("bits_per_byte"))
