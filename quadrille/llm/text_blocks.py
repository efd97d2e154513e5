"""Vectorised words of Arrow text batches.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8 text. Work is done in blocks of
a few megabytes, so memory does not follow the batch size; a single text longer than a block is one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK_BYTES = 1 << 21

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_TABLE = LOWER.tobytes()

_rng = np.random.Generator(np.random.PCG64(20240229))
#: Two independent byte tables and odd multipliers for polynomial word hashes modulo 2**64.
_TABLES = _rng.integers(1, 2**64, size=(2, 256), dtype=np.uint64)
_MULT = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(r: int, n: int) -> np.ndarray:
    out = np.full(n, U(r))
    out[0] = 1
    return np.multiply.accumulate(out)


_POW: dict[int, np.ndarray] = {}


def _pow(r: int, n: int) -> np.ndarray:
    have = _POW.get(r)
    if have is None or len(have) < n:
        have = _powers(r, max(n, BLOCK_BYTES + 1))
        if n <= 2 * BLOCK_BYTES:
            _POW[r] = have
    return have[:n]


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if n else raw[:0], at - at[0] if n else np.zeros(1, np.int64)


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of all words, and the number of words of each document."""
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    word = ~_SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] |= word[cuts]
    last[cuts - 1] |= word[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of each word; ``which`` picks one of two independent functions."""
    if not len(starts):
        return np.zeros(0, U)
    r = _MULT[which]
    inverse = pow(r, -1, 2**64)
    total = np.zeros(len(raw) + 1, U)
    np.cumsum(_TABLES[which][raw] * _pow(r, len(raw)), out=total[1:])
    h = (total[ends] - total[starts]) * _pow(inverse, len(raw))[starts]
    return mix(h + (ends - starts).astype(U) * U(0xA0761D6478BD642F))


def window_hashes(h: np.ndarray, counts: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of ``k`` words inside one document: (hash, index of the first word, windows of each document)."""
    wins = np.maximum(counts - k + 1, 0)
    if not wins.sum():
        return np.zeros(0, U), np.zeros(0, np.int64), wins
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    begin = np.repeat(first - np.concatenate([[0], np.cumsum(wins)[:-1]]), wins) + np.arange(int(wins.sum()))
    n = len(h) - k + 1
    acc = np.full(n, U((0x8EBC6AF09C88C6E3 * (2 * k + 1) + seed) % 2**64))
    for i in range(k):
        acc = (acc ^ h[i : i + n]) * U(0x9FB21C651E98DF25)
        acc ^= acc >> U(29)
    return mix(acc[begin]), begin, wins
