"""MPEG audio as a column: frames are written, found again, checked and indexed.

``pack`` stores bytes losslessly as a variable-bitrate Layer III stream: an ID3v2
tag, a Xing frame with a seek table, then silent frames, each with a checksum,
whose ancillary bytes carry the data. ``parse`` reads any MPEG-1, 2 or 2.5
stream of layers I to III: it skips tags, resynchronises on frame headers that a
second header confirms, verifies checksums of all three layers and reads Xing or
VBRI tables with their seek points.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from refweave.llm.shared import lean

# Fixed values of ISO/IEC 11172-3 and 13818-3: bit rates in kbit/s by index, sample rates in Hz.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

FULL = 14  # bit rate index of full frames: 320 kbit/s
SIDE = 17  # bytes of side information of a mono MPEG-1 Layer III frame
HEAD = 4 + 2 + SIDE
UNIT = 64  # a payload is padded with zero bytes to a positive multiple of this


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    rate: int
    channels: int
    size: int
    samples: int
    kbps: int


@lru_cache(maxsize=4096)
def header(four: bytes) -> Header | None:
    """The frame header in four bytes, or None if they are none (free-format streams are not read)."""
    if len(four) < 4 or four[0] != 0xFF or four[1] < 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    index, rate = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3 or four[3] & 3 == 2:
        return None
    kbps = BITRATES[1 if version == 3 else 2, layer][index]
    hz, pad = RATES[version][rate], four[2] >> 1 & 1
    if layer == 1:
        size, samples = (12_000 * kbps // hz + pad) * 4, 384
    else:
        samples = 1152 if layer == 2 or version == 3 else 576
        size = samples * 125 * kbps // hz + pad
    return Header(version, layer, not four[1] & 1, hz, 1 if four[3] >> 6 == 3 else 2, size, samples, kbps)


def side_bytes(h: Header) -> int:
    return (17 if h.channels == 1 else 32) if h.version == 3 else (9 if h.channels == 1 else 17)


def _crc(crc: int, value: int, bits: int) -> int:
    for k in range(bits - 1, -1, -1):
        crc = (crc << 1 ^ (0x8005 if (crc >> 15 ^ value >> k) & 1 else 0)) & 0xFFFF
    return crc


@lru_cache(maxsize=4096)
def checksum(data: bytes) -> int:
    """CRC-16 of polynomial 0x8005 from 0xFFFF, as frames carry it."""
    return _crc(0xFFFF, int.from_bytes(data, "big"), 8 * len(data))


# Fixed values of the standard for Layer II: (subbands, bits of allocation) from the lowest subband on, by table.
ALLOCATION = {
    "a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)), "lsf": ((4, 4), (7, 3), (19, 2)),
}


def allocation_of(h: Header) -> list[int]:
    """Bits that the allocation of each coded subband takes in a Layer II frame."""
    each = h.kbps // h.channels
    if h.version != 3:
        name = "lsf"
    elif each <= 48:
        name = "d" if h.rate == 32000 else "c"
    else:
        name = "a" if each <= 80 or h.rate == 48000 else "b"
    return [bits for count, bits in ALLOCATION[name] for _ in range(count)]


def expected_checksum(data: bytes, at: int, h: Header) -> int:
    """What a protected frame's checksum must be: it covers half the header and, by layer, side information, allocation, or allocation and scale selectors."""
    if h.layer == 3:
        return checksum(data[at + 2 : at + 4] + data[at + 6 : at + 6 + side_bytes(h)])
    joint = data[at + 3] >> 6 == 1
    bits = [4] * 32 if h.layer == 1 else allocation_of(h)
    bound = min(4 * ((data[at + 3] >> 4 & 3) + 1), len(bits)) if joint else len(bits)
    body = data[at + 6 : at + h.size]
    stream, room = int.from_bytes(body, "big"), 8 * len(body)
    used, selectors = 0, 0
    for band, width in enumerate(bits):
        for _ in range(h.channels if band < bound else 1):
            used += width
            if used <= room and (stream >> (room - used)) & ((1 << width) - 1):
                selectors += 2 * (1 if band < bound else h.channels)
    used = min(used + (selectors if h.layer == 2 else 0), room)
    return _crc(checksum(data[at + 2 : at + 4]), stream >> (room - used), used)


def _head(index: int, protected: bool) -> bytes:
    return bytes((0xFF, 0xFA if protected else 0xFB, index << 4 | 2 << 2, 0xC0))


_ROOM = [0] + [header(_head(i, True)).size - HEAD for i in range(1, 15)]


def _start(index: int) -> bytes:
    four = _head(index, True)
    return four + struct.pack(">H", checksum(four[2:] + bytes(SIDE))) + bytes(SIDE)


_STARTS = [b""] + [_start(i) for i in range(1, 15)]


def _synchsafe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def pack(data: bytes, length: int | None = None) -> bytes:
    """``data`` in frames; the tag notes its length and ``length``, that of what it was padded from."""
    note = f"\x03payload\x00{len(data)}/{len(data) if length is None else length}".encode()
    frame = b"TXXX" + _synchsafe(len(note)) + b"\0\0" + note
    tag = b"ID3\x04\x00\x00" + _synchsafe(len(frame)) + frame
    room, size = _ROOM[FULL], _ROOM[FULL] + HEAD
    full = len(data) // room
    body = np.zeros((full, size), np.uint8)
    body[:, :HEAD] = np.frombuffer(_STARTS[FULL], np.uint8)
    body[:, HEAD:] = np.frombuffer(data, np.uint8, full * room).reshape(full, room)
    rest, tail = data[full * room :], b""
    if rest:
        index = next(i for i in range(1, 15) if _ROOM[i] >= len(rest))
        tail = _STARTS[index] + rest + bytes(_ROOM[index] - len(rest))
    frames = full + bool(rest)
    first = header(_head(1, False)).size
    total = first + body.nbytes + len(tail)
    toc = bytes(min(255, 256 * (first + min(p * frames // 100, full) * size) // total) for p in range(100))
    xing = b"Xing" + struct.pack(">III", 15, frames, total) + toc + struct.pack(">I", 100)
    lead = _head(1, False) + bytes(SIDE) + xing
    return tag + lead + bytes(first - len(lead)) + body.tobytes() + tail


@dataclass
class Stream:
    """What a stream holds. ``offsets`` are the byte places of audio frames; ``spans`` their (start, end) of ancillary room for mono Layer III."""

    tags: dict = field(default_factory=dict)
    vbr: dict | None = None
    offsets: list = field(default_factory=list)
    headers: list = field(default_factory=list)
    checked: int = 0
    failed: int = 0
    skipped: int = 0  # bytes that belong to no frame and no tag

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def rate(self) -> int:
        return self.headers[0].rate if self.headers else 0

    def feature(self) -> str:
        h = self.headers[0] if self.headers else None
        kinds = f"mpeg{ {3: '1', 2: '2', 0: '2.5'}[h.version] }-layer{h.layer}" if h else "none"
        rates = sorted({x.kbps for x in self.headers})
        return ";".join(
            (kinds, f"{self.rate}Hz", f"channels={h.channels if h else 0}", f"frames={len(self.headers)}", f"samples={self.samples}", f"kbps={'-'.join(map(str, rates[:1] + rates[1:][-1:]))}", f"crc={self.checked - self.failed}/{self.checked}", f"table={'-' if self.vbr is None else self.vbr['kind'] + ':' + str(self.vbr['frames'])}", f"skipped={self.skipped}")
        )


def _id3v2(data: bytes) -> tuple[int, dict]:
    """Size of a leading tag and its TXXX texts."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, {}
    size = data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]
    end = min(len(data), 10 + size)
    texts, at = {}, 10
    while at + 10 <= end and data[at : at + 4].strip(b"\0"):
        raw = data[at + 4 : at + 8]
        n = raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3] if data[3] == 4 else int.from_bytes(raw, "big")
        if data[at : at + 4] == b"TXXX" and data[at + 10 : at + 11] in (b"\0", b"\3"):
            name, _, value = data[at + 11 : at + 10 + n].partition(b"\0")
            texts[name.decode("latin-1")] = value.rstrip(b"\0").decode("utf-8", "replace")
        at += 10 + n
    return 10 + size + (10 if data[5] & 16 else 0), texts


def _table(data: bytes, at: int, h: Header) -> dict | None:
    """A Xing or Info table, or a VBRI table, in the frame at ``at``. ``toc``: byte places from that frame on, at even steps of time."""
    x = at + 4 + side_bytes(h) + (2 if h.protected else 0)
    kind = data[x : x + 4]
    number = lambda place, n: int.from_bytes(data[place : place + n], "big")
    if kind in (b"Xing", b"Info"):
        flags, y = number(x + 4, 4), x + 8
        out = {"kind": kind.decode(), "frames": 0, "bytes": 0, "toc": []}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], y = number(y, 4), y + 4
        if flags & 4:
            out["toc"] = [share * out["bytes"] // 256 for share in data[y : y + 100]]
        return out
    if data[at + 36 : at + 40] == b"VBRI":
        entries, scale, width = (number(at + 54 + 2 * k, 2) for k in range(3))
        entries = min(entries, max(0, h.size - 62) // max(width, 1))
        sizes = [scale * number(at + 62 + width * k, width) for k in range(entries)]
        return {"kind": "VBRI", "frames": number(at + 50, 4), "bytes": number(at + 46, 4), "toc": np.cumsum(sizes, dtype=np.int64).tolist()}
    return None


def parse(data: bytes) -> Stream:
    """Frames of a stream. Bytes between frames are passed over; a frame found after a gap must be followed by a second one or the end.

    'TAG' 128 bytes before the end is an ID3v1 tag, unless a frame holds it and ends where the stream does.
    """
    out = Stream()
    at, out.tags = _id3v2(data)
    end = len(data) - 128 if len(data) >= 128 and data[-128:-125] == b"TAG" else len(data)
    synced, first = False, True
    while at + 4 <= end:
        h = header(data[at : at + 4])
        good = h is not None and (at + h.size <= end or at + h.size == len(data))
        if good and not synced:
            nxt = header(data[at + h.size : at + h.size + 4])
            good = at + h.size in (end, len(data)) or nxt is not None and (nxt.version, nxt.layer, nxt.rate) == (h.version, h.layer, h.rate)
        if not good:
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.skipped += nxt - at
            at, synced = nxt, False
            continue
        if first and h.layer == 3 and (table := _table(data, at, h)):
            out.vbr = table
        else:
            out.offsets.append(at)
            out.headers.append(h)
            if h.protected:
                out.checked += 1
                out.failed += expected_checksum(data, at, h) != int.from_bytes(data[at + 4 : at + 6], "big")
        first, synced = False, True
        at += h.size
    out.skipped += max(0, end - at)
    return out


def unpack(data: bytes, stream: Stream | None = None) -> tuple[bytes, int]:
    """The bytes that ``pack`` stored and their length before padding. A stream that lost some of them, or is none of its own, is a ValueError."""
    s = stream or parse(data)
    noted = re.fullmatch(r"([0-9]{1,18})/([0-9]{1,18})", s.tags.get("payload", ""), re.ASCII)
    if not noted or any(h.layer != 3 or not h.protected for h in s.headers):
        raise ValueError("no stream that pack has written")
    size, length = int(noted[1]), int(noted[2])
    parts = [data[o + HEAD : o + h.size] for o, h in zip(s.offsets, s.headers)]
    out = b"".join(parts)[:size]
    if len(out) < size:
        raise ValueError(f"payload of {size} bytes noted, {len(out)} found")
    return out, length


def pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def store(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, media): each text (null: empty) as UTF-8, padded and packed. Equal texts give equal media.

    A row per row of ``documents``, also where doc_ids are null or repeat; other
    columns are ignored, and an empty table gives an empty frame.
    """

    def run(batches):
        for batch in batches:
            media = [pack(pad(raw := (t or "").encode("utf-8", "surrogatepass")), len(raw)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(media, pa.binary())], ["doc_id", "media"])

    rows = documents.select(documents[key].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text"))
    return lean(rows).mapInArrow(run, "doc_id long, media binary")


# Columns of ``index``: name, SQL type and Arrow type.
INDEX = (
    ("doc_id", "long", pa.int64()), ("n_bytes", "long", pa.int64()), ("payload_bytes", "long", pa.int64()), ("payload_sha256", "string", pa.string()),
    ("tail_crc32", "long", pa.int64()), ("media_bytes", "long", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string()),
    ("samples", "long", pa.int64()), ("rate", "int", pa.int32()), ("duration", "double", pa.float64()), ("frame_offsets", "array<long>", pa.list_(pa.int64())),
    ("seek_points", "array<long>", pa.list_(pa.int64())),
)


def index(media: DataFrame) -> DataFrame:
    """The columns of ``INDEX`` for each stream of ``media`` (doc_id, media).

    The duration in seconds is samples / rate, and exactly so as that fraction;
    ``seek_points`` are those of the variable-bitrate table. Null media and bytes
    without frames have no offsets and a null duration; payload facts are null
    where ``pack`` did not write the stream, or frames of it are lost. Null and
    repeated doc_ids keep their rows; an empty table gives an empty frame.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for key, blob in zip(batch.column("doc_id").to_pylist(), batch.column("media")):
                data = blob.as_py() or b""
                s = parse(data)
                try:
                    payload, length = unpack(data, s)
                    facts = (length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]))
                except ValueError:
                    facts = (None,) * 4  # lost frames: wrong facts would be worse than none
                seconds = s.samples / s.rate if s.rate else None
                rows.append((key, *facts, len(data), hashlib.sha256(data).hexdigest(), s.feature(), s.samples, s.rate, seconds, s.offsets, s.vbr["toc"] if s.vbr else []))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, _, t) in zip(zip(*rows) if rows else [[]] * len(INDEX), INDEX)], [n for n, _, _ in INDEX])

    return lean(media).mapInArrow(run, ", ".join(f"{n} {t}" for n, t, _ in INDEX))
