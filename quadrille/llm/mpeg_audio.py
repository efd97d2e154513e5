"""MPEG audio in binary columns: parsing, durations and seek offsets, and a lossless carrier of payloads.

``parse`` reads a stream as a player would: ID3v2 tags in front and ID3v1 behind, frame headers of MPEG 1, 2 and 2.5,
layers I to III, resynchronised by two fitting headers in a row after anything else, the variable-bitrate table (Xing
or Info, VBRI) of the first frame, and the CRC-16 of protected layer III frames. The duration is exact: samples by the
sample rate, from the frames that are there, as a fraction.

``carry`` stores a payload of a multiple of 192 bytes in a stream of MPEG-1 layer III frames (mono, 32 kHz, 48 kbit/s,
216 bytes, protected): 192 bytes of payload in each frame's main data, behind an empty side information, after an ID3v2
tag with the payload's length and CRC-32 and an Info frame with the number of frames, bytes and the seek table.
``recover`` parses the stream and gives the payload back.

Defined results: null or empty bytes, or bytes without a frame: 0 frames, duration 0, no offsets. Damaged frames are
counted and skipped; rows that repeat are read alike; extra columns are passed by.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAYLOAD = 192
_V1 = {1: (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), 2: (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), 3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)}
_V2 = {1: (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), 3: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def _crc_table() -> np.ndarray:
    out = np.zeros(256, np.uint16)
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        out[i] = c & 0xFFFF
    return out


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 (0x8005, from 0xFFFF) of each row of bytes."""
    c = np.full(len(rows), 0xFFFF, np.uint16)
    for i in range(rows.shape[1]):
        c = (c << np.uint16(8)) ^ _CRC[(c >> np.uint16(8)) ^ rows[:, i]]
    return c


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG 1, 2: MPEG 2, 0: MPEG 2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    samples: int
    size: int
    side: int


_headers: dict[int, Header | None] = {}


def header(word: int) -> Header | None:
    """The frame header of these four bytes, or None."""
    if word in _headers:
        return _headers[word]
    out = None
    version, layer, bits, at = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
    if word >> 21 == 0x7FF and version != 1 and layer != 4 and 0 < bits < 15 and at < 3 and word & 3 != 2:
        kbps, rate, pad, mono = (_V1 if version == 3 else _V2)[layer][bits], _RATES[version][at], word >> 9 & 1, word >> 6 & 3 == 3
        samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
        size = (12000 * kbps // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + pad
        side = 0 if layer != 3 else (17 if mono else 32) if version == 3 else (9 if mono else 17)
        out = Header(version, layer, not word >> 16 & 1, kbps, rate, mono, samples, size, side)
    if len(_headers) < 1 << 16:
        _headers[word] = out
    return out


@dataclass
class Stream:
    """What a stream holds; offsets are of its audio frames, without the frame of the variable-bitrate table."""

    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    samples: int = 0
    rate: int = 0
    first: Header | None = None
    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict[str, object] = field(default_factory=dict)
    skipped: int = 0
    checked: int = 0
    bad_checks: int = 0
    constant: bool = True

    @property
    def seconds(self) -> float:
        return self.samples / self.rate if self.rate else 0.0


def _synchsafe(b: bytes) -> int:
    return (b[0] & 127) << 21 | (b[1] & 127) << 14 | (b[2] & 127) << 7 | b[3] & 127


def _id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Reads a tag's text frames; the place after it."""
    major, size = data[at + 3], _synchsafe(data[at + 6 : at + 10])
    end = min(len(data), at + 10 + size)
    i = at + 10
    while i + 10 <= end and data[i] != 0:
        name = data[i : i + 4].decode("latin-1")
        n = _synchsafe(data[i + 4 : i + 8]) if major >= 4 else int.from_bytes(data[i + 4 : i + 8], "big")
        body = data[i + 10 : min(end, i + 10 + n)]
        if name[:1] == "T" and body:
            text = body[1:].decode({1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace").strip("\0")
            key, _, value = text.partition("\0")
            tags[key if name == "TXXX" else name] = value if name == "TXXX" else text
        i += 10 + n
    return end + (10 if data[at + 5] & 16 else 0)


def _table(frame: bytes, h: Header) -> dict[str, object]:
    """The variable-bitrate table of a first frame, or nothing."""
    for at in {4 + h.side, 4 + h.side + 2 * h.protected}:
        if frame[at : at + 4] in (b"Xing", b"Info"):
            out: dict[str, object] = {"kind": frame[at : at + 4].decode()}
            flags, i = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
            for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
                if flags & bit:
                    out[name] = list(frame[i : i + n]) if n == 100 else int.from_bytes(frame[i : i + n], "big")
                    i += n
            return out
    if frame[36:40] == b"VBRI":
        count, scale, width, step = (int.from_bytes(frame[a : a + 2], "big") for a in (54, 56, 58, 60))
        toc = [int.from_bytes(frame[62 + width * k : 62 + width * (k + 1)], "big") * scale for k in range(count)]
        return {"kind": "VBRI", "bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big"), "toc": toc, "frames_per_entry": step}
    return {}


def parse(data: bytes | None) -> Stream:
    """All that the stream holds. A frame counts if another fitting header, a tag or the end follows it."""
    s = Stream()
    if not data:
        return s
    at, end = 0, len(data)
    tail = end - 128 if data[end - 128 : end - 125] == b"TAG" and end >= 128 else -1  # an ID3v1 tag, if frames lead there
    offsets: list[int] = []
    sizes: list[int] = []
    word = struct.Struct(">I").unpack_from
    guarded: list[int] = []
    previous = None
    while at + 4 <= end:
        if at == tail:
            for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
                if text := data[at + a : at + b].split(b"\0")[0].decode("latin-1").strip():
                    s.tags.setdefault(f"v1.{name}", text)
            at = end
            break
        if data[at : at + 3] == b"ID3" and at + 10 <= end:
            at = _id3v2(data, at, s.tags)
            previous = None
            continue
        h = header(word(data, at)[0])
        fits = h is not None and at + h.size <= end
        if fits and previous is None:  # after anything but a frame, two headers in a row
            after = at + h.size
            following = header(word(data, after)[0]) if after + 4 <= end else None
            fits = after in (end, tail) or data[after : after + 3] == b"ID3" or (following is not None and (following.version, following.layer, following.rate) == (h.version, h.layer, h.rate))
        if not fits:
            spots = [data.find(b"\xff", at + 1, end), tail if tail > at else -1]
            spots = [x for x in spots if x >= 0]
            to = min(spots, default=end)
            tag = data.find(b"ID3", at + 1, to)
            to = tag if tag >= 0 else to
            s.skipped += to - at
            at, previous = to, None
            continue
        if not offsets and not s.vbr and (found := _table(data[at : at + h.size], h)):
            s.vbr = found
        else:
            offsets.append(at)
            sizes.append(h.size)
            s.samples += h.samples
            s.first = s.first or h
            s.constant &= h.kbps == s.first.kbps
            s.rate = s.rate or h.rate
        if h.protected and h.layer == 3:
            guarded.append(at)
        previous = h
        at += h.size
    s.skipped += max(0, end - at)
    s.offsets, s.sizes = np.array(offsets, np.int64), np.array(sizes, np.int64)
    if guarded:
        raw = np.frombuffer(data, np.uint8)
        g = np.array(guarded)
        s.checked = len(g)
        side = np.array([header(word(data, a)[0]).side for a in guarded]) if len(set(sizes)) > 1 or s.vbr else np.full(len(g), s.first.side)
        for k in np.unique(side):
            own = g[side == k]
            for i in range(0, len(own), 1 << 14):
                o = own[i : i + (1 << 14), None]
                body = np.concatenate([raw[o + [2, 3]], raw[o + 6 + np.arange(k)]], 1)
                said = raw[o[:, 0] + 4].astype(np.uint16) << np.uint16(8) | raw[o[:, 0] + 5]
                s.bad_checks += int((crc16(body) != said).sum())
    return s


#: MPEG 1, layer III, protected, 48 kbit/s, 32 kHz, mono
_HEAD = bytes([0xFF, 0xFA, 0x38, 0xC0])
_HEADER = header(int.from_bytes(_HEAD, "big"))
_DATA = 4 + 2 + _HEADER.side
_FRAME = np.zeros(_HEADER.size, np.uint8)
_FRAME[:4] = np.frombuffer(_HEAD, np.uint8)
_FRAME[4:6] = np.frombuffer(struct.pack(">H", int(crc16(np.frombuffer(_HEAD[2:] + bytes(_HEADER.side), np.uint8)[None])[0])), np.uint8)


def _text_frame(key: str, value: str) -> bytes:
    body = b"\x03" + key.encode() + b"\0" + value.encode()
    return b"TXXX" + struct.pack(">I", len(body)) + b"\0\0" + body


def carry(payload: bytes, unpadded: int) -> bytes:
    """A stream with this payload; ``unpadded``: how much of it is content."""
    n = len(payload) // PAYLOAD
    frames = np.tile(_FRAME, (n + 1, 1))
    frames[1:, _DATA : _DATA + PAYLOAD] = np.frombuffer(payload, np.uint8).reshape(n, PAYLOAD)
    info = b"Info" + struct.pack(">III", 7, n, (n + 1) * _HEADER.size) + bytes(min(255, 256 * k // 100) for k in range(100))
    frames[0, _DATA : _DATA + len(info)] = np.frombuffer(info, np.uint8)
    body = _text_frame("payload_bytes", str(unpadded)) + _text_frame("payload_crc32", f"{zlib.crc32(payload):08x}")
    size = len(body)
    tag = b"ID3\x03\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + body
    return tag + frames.tobytes()


def recover(data: bytes) -> tuple[bytes, Stream]:
    """(payload, stream) of what ``carry`` made. Raises ValueError if a checksum fails."""
    s = parse(data)
    raw = np.frombuffer(data, np.uint8)
    out = bytearray()
    for i in range(0, len(s.offsets), 1 << 13):
        out += raw[s.offsets[i : i + (1 << 13), None] + _DATA + np.arange(PAYLOAD)].tobytes()
    if s.bad_checks or s.tags.get("payload_crc32") != f"{zlib.crc32(out):08x}":
        raise ValueError("the stored stream is damaged")
    return bytes(out), s


def describe(s: Stream) -> str:
    """One line about a stream."""
    if s.first is None:
        return "none"
    h = s.first
    return f"mpeg{ {3: '1', 2: '2', 0: '2.5'}[h.version] }-layer{h.layer} {h.rate}Hz {'mono' if h.mono else 'stereo'} {h.kbps if s.constant else 'vbr'}kbps frames={len(s.offsets)} samples={s.samples} seconds={s.samples}/{s.rate} table={s.vbr.get('kind', 'none')}:{s.vbr.get('frames', 0)} crc={s.checked - s.bad_checks}/{s.checked} skipped={s.skipped} first={int(s.offsets[0])} last={int(s.offsets[-1])}"


def read_media(rows: DataFrame, media_col: str = "media", id_col: str = "doc_id", every: int = 64) -> DataFrame:
    """Per row: its id, kind, n_frames, samples, rate, seconds, table_frames, bad_checks, skipped, seek (offset of every
    ``every``-th frame), tags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                found = [parse(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([describe(s) for s in found], pa.string()), pa.array([len(s.offsets) for s in found], pa.int64()), pa.array([s.samples for s in found], pa.int64()),
                        pa.array([s.rate for s in found], pa.int32()), pa.array([s.seconds for s in found], pa.float64()), pa.array([s.vbr.get("frames", 0) for s in found], pa.int64()), pa.array([s.bad_checks for s in found], pa.int64()),
                        pa.array([s.skipped for s in found], pa.int64()), pa.array([s.offsets[::every] for s in found], pa.list_(pa.int64())), pa.array([list(s.tags.items()) for s in found], pa.map_(pa.string(), pa.string())),
                    ],
                    names=["id", "kind", "n_frames", "samples", "rate", "seconds", "table_frames", "bad_checks", "skipped", "seek", "tags"],
                )

    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, kind string, n_frames long, samples long, rate int, seconds double, table_frames long, bad_checks long, skipped long, seek array<long>, tags map<string,string>"
    return rows.select(F.col(id_col).alias("id"), F.col(media_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def padded(text: bytes) -> bytes:
    """The payload of a text: bytes 32 up to a positive multiple of PAYLOAD."""
    return text + b" " * (-len(text) % PAYLOAD or (0 if text else PAYLOAD))


def _mapped(docs: DataFrame, id_col: str, text_col: str, schema: str, row) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = out = None
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                rows = [row(t.encode() if isinstance(t, str) else t or b"") for t in part.column(1).to_pylist()]
                names = list(rows[0])
                out = [pa.array([r[k] for r in rows]) for k in names]
                yield pa.RecordBatch.from_arrays([part.column(0), *out], names=["id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, media (binary), n_bytes, n_frames."""

    def row(text: bytes) -> dict:
        payload = padded(text)
        return {"media": carry(payload, len(text)), "n_bytes": len(text), "n_frames": len(payload) // PAYLOAD}

    return _mapped(docs, id_col, text_col, "media binary, n_bytes long, n_frames long", row)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text, reads it back and sums up: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, seconds, n_frames."""

    def row(text: bytes) -> dict:
        media = carry(padded(text), len(text))
        payload, s = recover(media)
        return {
            "n_bytes": int(s.tags["payload_bytes"]), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(media),
            "media_sha256": hashlib.sha256(media).hexdigest(), "feature": describe(s), "seconds": s.seconds, "n_frames": len(s.offsets),
        }

    return _mapped(docs, id_col, text_col, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, n_frames long", row)
