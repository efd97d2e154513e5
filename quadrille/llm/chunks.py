"""Questions and answers between chunks of documents and ranges of keys.

Documents are dealt into chunks of about ``CHUNK_BYTES`` of text by a hash of their id. A chunk asks about its
*distinct* keys only, packed as one sorted blob for each range of keys, so that a key shared by many documents
sends at most one entry for each chunk. A range gathers all questions about its keys and answers each blob in
the order asked. No key, however common, brings more than one entry a chunk into a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import text_blocks as tb

CHUNK_BYTES = 12 << 20
REQUEST = "part int, chunk int, kind int, body binary"
REQUEST_ARROW = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("kind", pa.int32()), ("body", pa.binary())])


def chunk_count(docs: DataFrame, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> int:
    """Chunks needed for these documents. Runs one aggregation over the text column."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, -(-int(total) // chunk_bytes))


def dealt(docs: DataFrame, key_col: str, chunks: int, name: str = "chunk") -> DataFrame:
    """Documents partitioned by chunk; rows of one id share a chunk."""
    return docs.withColumn(name, F.pmod(F.xxhash64(F.col(key_col)), F.lit(chunks)).cast("int")).repartition(chunks, name)


def ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Range of each 64-bit key; ascending with the key."""
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def bounds(sorted_keys: np.ndarray, parts: int) -> np.ndarray:
    """Offsets of the ranges 0..parts in ascending keys."""
    return np.searchsorted(ranges(sorted_keys, parts), np.arange(parts + 1))


def pack(*columns: np.ndarray) -> bytes:
    """Equal-length columns as bytes; the first must ascend and is stored as differences. Byte planes stand
    apart, so that the shuffle's own compression removes the empty ones."""
    n = len(columns[0])
    out = [np.int64(n).tobytes()]
    for i, c in enumerate(columns):
        c = np.ascontiguousarray(c)
        if i == 0:
            c = c.copy()
            c[1:] -= c[:-1].copy()
        out.append(c.view(np.uint8).reshape(n, c.dtype.itemsize).T.tobytes())
    return b"".join(out)


def unpack(body: bytes, *dtypes) -> list[np.ndarray]:
    """Columns of ``pack``."""
    raw = np.frombuffer(body, dtype=np.uint8)
    n, at, out = int(np.frombuffer(body[:8], np.int64)[0]), 8, []
    for i, d in enumerate(map(np.dtype, dtypes)):
        c = np.ascontiguousarray(raw[at : at + n * d.itemsize].reshape(d.itemsize, n).T).view(d).reshape(n)
        at += n * d.itemsize
        out.append(np.cumsum(c, dtype=d) if i == 0 else c)
    return out


def requests(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    """Rows of the REQUEST schema."""
    part, chunk, kind, body = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table([pa.array(part, pa.int32()), pa.array(chunk, pa.int32()), pa.array(kind, pa.int32()), pa.array(body, pa.binary())], schema=REQUEST_ARROW)


def words_of(column: pa.ChunkedArray, lower: bool = False, seconds: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """(word hashes, second hashes or None, words of each document), block by block."""
    raw, offsets = tb.text_arrays(column)
    one, two, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in tb.blocks(offsets):
        part = raw[offsets[i] : offsets[j]]
        part = tb.LOWER[part] if lower else part
        starts, ends, n = tb.word_spans(part, offsets[i : j + 1] - offsets[i])
        one.append(tb.word_hashes(part, starts, ends))
        if seconds:
            two.append(tb.word_hashes(part, starts, ends, 1))
        counts.append(n)
    return np.concatenate(one), np.concatenate(two) if seconds else None, np.concatenate(counts)
