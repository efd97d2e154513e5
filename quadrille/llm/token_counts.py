"""Token counts of whole texts by a public subword vocabulary.

Only lengths leave the Arrow function. A text is cut at single spaces that stand between two non-space
characters: the pre-tokenizer of a byte-level vocabulary always starts a new piece there, so the pieces'
counts add up to the count of the whole text. A long text without such spaces is cut where a letter or digit meets
another kind of character, a new piece too, unless a special string lies across the cut. Pieces repeat, so each distinct one is encoded once per
worker, in batches balanced by bytes; the memory of pieces is emptied when it holds ``MEMORY`` of them.

Defined results: null or empty text: 0 bytes, 0 tokens. Special strings inside a text are handled as the
library does by default. Repeated rows are counted alike; other columns are passed through untouched.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 1 << 16
MEMORY = 1 << 20
LONGEST_KEPT = 64
TEXT_CHARS = 1 << 20
#: White space other than space, newline, tab and carriage return.
_RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_UNSAFE = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Ends of runs of letters, and of digits, where the pre-tokenizer ends a piece whatever follows.
_EDGE = regex.compile(r"(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}])")
_state: dict = {}


def _encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    _state["tokenizer"] = tokenizer
    _state["special"] = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _splits_at_spaces(path: str) -> bool:
    """Whether the vocabulary's pre-tokenizer is the byte-level one without a prefix space or normalizer."""
    if not path.endswith(".json"):
        return False
    import json

    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    pre = d.get("pre_tokenizer") or {}
    plain = all(not (t.get("lstrip") or t.get("rstrip") or " " in t["content"]) for t in d.get("added_tokens", []))
    return not d.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not d.get("post_processor") and plain


def _load(path: str) -> dict:
    if _state.get("path") != path:
        _state.clear()
        _state.update(encode=_encoder(path), split=_splits_at_spaces(path), known={})
        _state["path"] = path
    return _state


def _encode_pieces(s: dict, pieces: list[str]) -> dict[str, int]:
    """Counts of pieces, each meant with a space before it: they are encoded side by side, where no token
    crosses from one to the next, and each token is given to the piece in which it starts."""
    encoding = s["tokenizer"].encode(" " + " ".join(pieces), add_special_tokens=False)
    begins = np.cumsum([0, *(len(p) + 1 for p in pieces)])
    starts = np.fromiter((a for a, _ in encoding.offsets), np.int64, len(encoding))
    counts = np.bincount(np.searchsorted(begins, starts, side="right") - 1, minlength=len(pieces))
    return dict(zip(pieces, counts.tolist(), strict=True))


def _learn(s: dict, fresh: list[str]) -> dict[str, int]:
    """Counts of pieces, encoded in batches of about BATCH_BYTES characters."""
    out: dict[str, int] = {}
    batch: list[str] = []
    load = 0
    for piece in fresh:
        batch.append(piece)
        load += len(piece) + 1
        if load >= BATCH_BYTES:
            out |= _encode_pieces(s, batch)
            batch, load = [], 0
    if batch:
        out |= _encode_pieces(s, batch)
    return out


def _remember(known: dict[str, int], fresh: dict[str, int]) -> None:
    """Longer pieces are rarer: when the memory is full, the longer half goes."""
    known.update((p, n) for p, n in fresh.items() if len(p) <= LONGEST_KEPT)
    if len(known) > MEMORY:
        middle = sorted(map(len, known))[len(known) // 2]
        for p in [p for p in known if len(p) >= middle]:
            del known[p]


def _stretches(text: str, special: list[str] = ()) -> Iterator[tuple[bool, str]]:
    """A long text as stretches of about TEXT_CHARS: (whether it follows a cut at a safe space, the text after that space)."""
    at, n, spaced = 0, len(text), False
    while n - at > TEXT_CHARS:
        low, high = at + TEXT_CHARS, min(n, at + 2 * TEXT_CHARS)
        cut = _SAFE.search(text, low, high)
        if cut is not None:
            yield spaced, text[at : cut.start()]
            at, spaced = cut.end(), True
            continue
        edge = next((m.start() for m in _EDGE.finditer(text, low) if not _across(text, m.start(), special)), None)
        space = _SAFE.search(text, high, edge) if edge is not None and edge > high else _SAFE.search(text, high) if edge is None else None
        if space is not None:
            yield spaced, text[at : space.start()]
            at, spaced = space.end(), True
        elif edge is not None:
            yield spaced, text[at:edge]
            at, spaced = edge, False
        else:
            break
    yield spaced, text[at:]


def _across(text: str, at: int, special: list[str]) -> bool:
    """Whether a special string lies across a place."""
    return any(text.find(s, max(0, at - len(s) + 1), at + len(s) - 1) >= 0 for s in special if len(s) > 1)


def _pieces(text: str) -> list[str]:
    """The pieces of a text without the space before all but the first."""
    if _RARE_SPACE.search(text) or any(x in text for x in _UNSAFE):
        return _SAFE.split(text)
    if text[:1] == " " or text[-1:] == " ":
        return _SAFE.split(text)
    return text.split(" ")


def _count_split(s: dict, texts: list[str | None]) -> list[int]:
    """Counts of several texts; new pieces of all of them are encoded together."""
    known, first, owner, cut = s["known"], [], [], []
    for at, text in enumerate(texts):
        parts: list[list[str]] = []
        for spaced, stretch in _stretches(text or "", s["special"]):
            head, *rest = _pieces(stretch)
            if spaced:  # its head comes after the space of the cut, like all other pieces
                rest = [head, *rest]
            else:
                first.append(head)
                owner.append(at)
            parts.append(rest)
        cut.append(parts)
    fresh = {}
    missing = set().union(*(x for parts in cut for x in parts)).difference(known)
    if missing:
        fresh = _learn(s, sorted(missing))
        known.update(fresh)
    out = [sum(sum(map(known.__getitem__, x)) for x in parts) for parts in cut]
    for at, n in zip(owner, s["encode"](first), strict=True):
        out[at] += n
    for p in fresh:
        if len(p) > LONGEST_KEPT:
            del known[p]
    _remember(known, {})
    return out


def count_texts(path: str, texts: list[str | None]) -> list[int]:
    """Tokens of each text; null is the empty text."""
    s = _load(path)
    if s["split"]:
        return [n for at in range(0, len(texts), 64) for n in _count_split(s, texts[at : at + 64])]
    out: list[int] = []
    batch: list[str] = []
    load = 0
    for t in texts:
        batch.append(t or "")
        load += len(batch[-1])
        if load >= BATCH_BYTES:
            out += s["encode"](batch)
            batch, load = [], 0
    return out + (s["encode"](batch) if batch else [])


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row for each row of ``docs``: its id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``vocabulary``: path of the vocabulary file, the same on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                counts = count_texts(vocabulary, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
