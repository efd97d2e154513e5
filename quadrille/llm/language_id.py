"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its subwords: every 2, 3 and 4 bytes of the lower-cased letters with
single word ends between them, hashed into ``BUCKETS``. Embeddings and softmax are trained together by stochastic
gradient descent in numpy on a bounded sample, on the driver: about ``SAMPLE`` labelled texts of each of the ``LANGUAGES``
most frequent languages, whole texts of at most ``SAMPLE_BYTES``, and as many pieces of them. A temperature is fitted on texts kept apart, so the score is calibrated; a text is rejected
if its score stays below the least score that all but ``REJECTED`` of the kept texts and pieces of known language
reach. With a single learned language every score is 1, so only texts without a letter are rejected.

The model is linear in the subword counts, so it is one table of BUCKETS numbers for each language; scoring adds
them up over the whole text, block by block.

Defined results: a null text, or one without a letter: language ``und``, score 0, rejected. Without any labelled
text all texts are ``und``. Equal texts get equal results. lang and source are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import text_blocks as tb

BUCKETS, DIM = 1 << 14, 16
SAMPLE, SAMPLE_BYTES, LANGUAGES = 400, 1 << 17, 256
#: Bytes of a long text whose subwords are taken at once.
STRETCH = 1 << 22
EPOCHS, BATCH, RATE = 12, 64, 0.5
REJECTED = 0.0005
_U = np.uint32
#: Letters keep their lower-case byte, all bytes outside ASCII stay, anything else is a word end.
_LETTER = np.full(256, 32, np.uint8)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _normal(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased letters with one space for a run of others and one at each end, end to end; length of each document)."""
    x = _LETTER[raw]
    keep = x != 32
    keep[1:] |= keep[:-1]  # one space for a run of non-letters
    kept = np.concatenate([[0], np.cumsum(keep)])
    n = np.diff(kept[offsets])
    y = np.full(int(n.sum()) + 2 * len(n), 32, np.uint8)
    room = np.ones(len(y), bool)
    first = np.cumsum(n + 2) - (n + 2)
    room[first] = room[first + n + 1] = False
    y[room] = x[keep]
    return y, n + 2


def _hashed(y: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of the grams of 2, 3 and 4 bytes that begin at each byte."""
    h = y.astype(_U)
    for size in (2, 3, 4):
        h = h[:-1] * _U(0x01000193) ^ y[size - 1 :]
        z = h * _U(0x9E3779B1)
        yield (z ^ (z >> _U(15))) & _U(BUCKETS - 1)


def _grams(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets end to end, number in each document) of the grams of each size."""
    y, n = _normal(raw, offsets)
    first = np.cumsum(n) - n
    for size, codes in zip((2, 3, 4), _hashed(y), strict=True):
        whole = np.ones(len(codes), bool)
        for back in range(1, size):  # grams across a document's end
            at = first[1:] - back
            whole[at[(at >= 0) & (at < len(codes))]] = False
        yield codes[whole], np.maximum(n + 1 - size, 0)


def subwords(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Buckets of all subwords of each document."""
    cut = [np.split(codes, np.cumsum(n)[:-1]) for codes, n in _grams(raw, offsets)]
    return [np.concatenate(x) for x in zip(*cut, strict=True)]


def _totals(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum over each document's subwords of the table's columns, one row for each language; their number)."""
    out, count = np.zeros((len(offsets) - 1, len(table))), np.zeros(len(offsets) - 1, np.int64)
    for codes, n in _grams(raw, offsets):
        full = np.flatnonzero(n)
        count += n
        if len(full):
            at = (np.cumsum(n) - n)[full]
            for k, column in enumerate(table):
                out[full, k] += np.add.reduceat(column[codes], at, dtype=np.float64)
    return out, count


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Model:
    """Languages, the table of logits, temperature and the least score that isn't rejected."""

    def __init__(self, langs: list[str], table: np.ndarray, temperature: float, least: float):
        self.langs, self.table, self.temperature, self.least = langs, table, temperature, least

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score) of each text; -1 and 0 if it has no letter."""
        raw, offsets = tb.text_arrays(column)
        n = len(offsets) - 1
        best, score = np.full(n, -1), np.zeros(n)
        if not self.langs:
            return best, score
        for i, j in tb.blocks(offsets, 1 << 20):
            part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            total, count = _long_totals(part, self.table) if j - i == 1 and len(part) > STRETCH else _totals(part, at, self.table)
            p = _softmax(total / np.maximum(count, 1)[:, None] / self.temperature)
            letters = _has_letter(part, at)
            best[i:j] = np.where(letters, p.argmax(1), -1)
            score[i:j] = np.where(letters, p.max(1), 0)
        return best, score


def _long_totals(part: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_totals of one long text, whose grams are taken stretch by stretch, none lost between two."""
    y, _ = _normal(part, np.array([0, len(part)]))
    total, count = np.zeros((1, len(table))), 0
    for a in range(0, len(y), STRETCH):
        for codes in _hashed(y[a : a + STRETCH + 3]):
            codes = codes[:STRETCH]
            count += len(codes)
            total[0] += [column[codes].sum(dtype=np.float64) for column in table]
    return total, np.array([count])


def _has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = np.append(np.cumsum(((raw >= 65) & (raw <= 90)) | ((raw >= 97) & (raw <= 122))), 0)
    ascii_letter = np.concatenate([[0], ascii_letter[:-1]]) if len(raw) else np.zeros(1, np.int64)
    out = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for d in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[d] = any(map(str.isalpha, raw[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace")))
    return out


def train(texts: list[str], langs: list[str], seed: int = 0) -> Model:
    """Fits a model on whole texts and random pieces of them; every fifth text only calibrates."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((0, BUCKETS)), 1.0, 0.0)
    rng = np.random.Generator(np.random.PCG64(seed))
    y = np.array([names.index(x) for x in langs])
    pieces, labels, kept = [], [], []
    for i, (t, k) in enumerate(zip(texts, y.tolist(), strict=True)):
        words = t.split()
        at, n = (int(rng.integers(0, len(words))), int(rng.integers(1, 12))) if words else (0, 0)
        pieces += [t, " ".join(words[at : at + n])]
        labels += [k, k]
        kept += [i % 5 == 4 and len(texts) >= 10] * 2
    raw, offsets = tb.text_arrays(pa.array(pieces))
    rows = []
    for i, j in tb.blocks(offsets):
        cut = subwords(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        rows += [np.unique(c, return_counts=True) for c in cut]
    labels, kept = np.array(labels), np.array(kept)
    E = rng.normal(0, 0.1, (BUCKETS, DIM))
    W = np.zeros((DIM, len(names)))
    use = np.flatnonzero(~kept)

    def average(batch):
        codes = np.concatenate([rows[i][0] for i in batch])
        weight = np.concatenate([rows[i][1] / max(1, rows[i][1].sum()) for i in batch])
        owner = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
        return codes, weight, owner

    def forward(batch):
        codes, weight, owner = average(batch)
        x = np.zeros((len(batch), DIM))
        n = np.array([len(rows[i][0]) for i in batch])
        full = np.flatnonzero(n)
        if len(full):
            x[full] = np.add.reduceat(E[codes] * weight[:, None], (np.cumsum(n) - n)[full])
        return x, codes, weight, owner

    balance = len(use) / (len(names) * np.maximum(1, np.bincount(labels[use], minlength=len(names))))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for batch in np.array_split(rng.permutation(use), max(1, len(use) // BATCH)):
            x, codes, weight, owner = forward(batch)
            g = _softmax(x @ W)
            g[np.arange(len(batch)), labels[batch]] -= 1
            g *= balance[labels[batch]][:, None]
            back = g @ W.T
            W -= rate * x.T @ g / len(batch) * 8
            # sums of subword gradients by bucket
            order = np.argsort(codes, kind="stable")
            c = codes[order]
            if len(c):
                new = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
                E[c[new]] -= rate * 8 * np.add.reduceat(back[owner[order]] * weight[order, None], new)
    table = E @ W
    check = np.flatnonzero(kept) if kept.any() else use
    z = np.concatenate([forward(b)[0] @ W for b in np.array_split(check, max(1, len(check) // 256))])
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(check)), labels[check]] + 1e-12).mean()
    temperature = min(np.geomspace(0.05, 5, 60), key=loss)
    known = _softmax(z / temperature).max(1)[[len(rows[i][0]) > 0 for i in check]]
    return Model(names, np.ascontiguousarray(table.T, np.float32), float(temperature), float(np.quantile(known, REJECTED)) if len(known) else 0.0)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Trains on about ``sample`` rows of each language, those with the smallest hashes of their ids."""
    rows = labelled.where(F.col(lang_col).isNotNull() & (F.octet_length(text_col) <= SAMPLE_BYTES))
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(LANGUAGES).collect()}
    if not counts:
        return train([], [])
    share = F.coalesce(*[F.when(F.col(lang_col) == k, F.lit(min(1.0, sample / n))) for k, n in counts.items()], F.lit(0.0))
    order = (F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)).cast("double")
    chosen = rows.where(order < share).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), order.alias("o"), F.octet_length(text_col).alias("b"))
    got = sorted(((r.o, r.lang, r.text) for r in chosen.toLocalIterator()), key=lambda r: (r[0], r[1], r[2]))
    return train([r[2] for r in got], [r[1] for r in got])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: its id, lang_pred, score (calibrated, 0 to 1), rejected."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((model.langs, model.table, model.temperature, model.least))  # BUCKETS x languages floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        names = np.array([*m.langs, "und"], object)
        for b in batches:
            best, score = m.scores(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array((best < 0) | (score < m.least))], names=["id", "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents whose language is recognised, all columns as they are."""
    context, names = docs.sparkSession.sparkContext, [f"c{i}" for i in range(len(docs.columns))]
    shared = context.broadcast((model.langs, model.table, model.temperature, model.least))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            best, score = m.scores(b.column(at))
            yield b.filter(pa.array((best >= 0) & (score >= m.least)))

    plain = docs.toDF(*names)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
