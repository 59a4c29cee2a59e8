import hashlib
import random
import struct
import zlib

import pytest

from refweave.llm import mpegaudio as M
from refweave.llm import registry
from refweave.llm.shared import table


def padded(text):
    raw = (text or "").encode()
    return raw, raw + b"\0" * (-len(raw) % 64 if raw else 64)


def check(r, text):
    raw, payload = padded(text)
    assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_round_trip():
    rng = random.Random(1)
    for n in (0, 1, 63, 64, 65, 121, 1416, 1417, 1418, 1417 * 3, 50_000):
        data = rng.randbytes(n)
        if n == 50_000:
            data = b"\xff\xfa\xe8\xc0" * 12_500  # looks like headers
        media = M.pack(data)
        s = M.parse(media)
        assert M.unpack(media, s) == (data, n)
        assert s.skipped == 0 and s.failed == 0 and s.checked == len(s.offsets) == s.vbr["frames"]
        assert s.vbr["bytes"] == len(media) - (10 + int.from_bytes(media[9:10], "big") + (media[8] << 7))
        assert all(M.header(media[o : o + 4]) for o in s.offsets)


def test_resynchronises():
    media = M.pack(b"payload!" * 1000, 8000)
    clean = M.parse(media)
    noise = b"junk \xff\xfb\x90 more \xff"
    cut = clean.offsets[2]
    broken = media[:cut] + noise + media[cut:] + b"TAG" + bytes(125)
    s = M.parse(broken)
    assert len(s.offsets) == len(clean.offsets) and s.skipped == len(noise) and s.failed == 0
    assert s.samples == clean.samples == 1152 * len(clean.offsets)
    flipped = bytearray(media)
    flipped[clean.offsets[1] + 10] ^= 1  # in the side information
    assert M.parse(bytes(flipped)).failed == 1
    truncated = M.parse(media[:-5])
    assert len(truncated.offsets) == len(clean.offsets) - 1 and truncated.skipped > 0


def test_headers_of_the_standard():
    # 128 kbit/s: 417 bytes at 44.1 kHz, 418 with the padding bit; MPEG-2 Layer III at 64 kbit/s and 22.05 kHz: 208.
    assert (M.header(b"\xff\xfb\x90\x00").size, M.header(b"\xff\xfb\x92\x00").size) == (417, 418)
    h = M.header(b"\xff\xf3\x80\xc0")
    assert (h.size, h.samples, h.rate, h.channels, M.side_bytes(h)) == (208, 576, 22050, 1, 9)
    assert M.header(b"\xff\xff\x44\x00").size == 32 * 4 * 12000 // 48000 * 0 + (12000 * 128 // 48000) * 4
    assert [M.header(x) for x in (b"\xff\xe8\x90\x00", b"\xff\xfb\xf0\x00", b"\xff\xfb\x0c\x00", b"abcd", b"\xff")] == [None] * 5


def test_checksum_and_vbri():
    assert M.checksum(b"123456789") == 0xAEE7  # CRC-16/CMS
    frame = bytearray(417)
    frame[:4] = b"\xff\xfb\x90\x00"
    frame[36:40] = b"VBRI"
    frame[46:54] = struct.pack(">II", 4170, 9)
    frame[54:62] = struct.pack(">HHHH", 3, 3, 2, 3)  # entries, scale, bytes of an entry, frames of an entry
    frame[62:68] = struct.pack(">HHH", 417, 417, 417)
    s = M.parse(bytes(frame) + (b"\xff\xfb\x90\x00" + bytes(413)) * 9)
    assert s.vbr["kind"] == "VBRI" and s.vbr["frames"] == len(s.offsets) == 9 and s.samples / s.rate == 9 * 1152 / 44100
    assert s.vbr["toc"] == [1251, 2502, 3753]  # three frames each


def bits_of(data):
    return "".join(f"{b:08b}" for b in data)


def crc_of(bits):
    crc = 0xFFFF
    for b in bits:
        out = (crc >> 15) ^ int(b)
        crc = (crc << 1) & 0xFFFF
        if out:
            crc ^= 0x8005
    return crc


@pytest.mark.parametrize("four,covered", [
    (b"\xff\xfe\x84\xc0", lambda b: 32 * 4),  # Layer I, mono
    (b"\xff\xfe\x84\x00", lambda b: 64 * 4),  # Layer I, stereo
    (b"\xff\xfe\x84\x50", lambda b: (2 * 8 + 24) * 4),  # Layer I, joint stereo from subband 8 on
    (b"\xff\xfc\x14\xc0", None),  # Layer II, 32 kbit/s mono at 48 kHz: eight subbands
    (b"\xff\xfc\xa0\x00", None),  # Layer II, 192 kbit/s stereo at 44.1 kHz: thirty subbands
    (b"\xff\xf4\x84\x60", None),  # Layer II of MPEG-2, joint stereo from subband 12 on
])
def test_checksums_of_layers_one_and_two(four, covered):
    h = M.header(four)
    body = bytearray(random.Random(four).randbytes(h.size))
    body[:4] = four
    bits = bits_of(bytes(body[6:]))
    if covered:
        n = covered(bits)
    else:
        widths = {8: [4, 4] + [3] * 6, 30: [4] * 11 + [3] * 12 + [2] * 7, 31: [4] * 4 + [3] * 7 + [2] * 19}[{0x14: 8, 0xA0: 30, 0x84: 31}[four[2]]]
        bound = 12 if four[3] >> 6 == 1 else len(widths)
        at = chosen = 0
        for band, w in enumerate(widths):
            for _ in range(h.channels if band < bound else 1):
                if "1" in bits[at : at + w]:
                    chosen += 1 if band < bound else h.channels
                at += w
        n = at + 2 * chosen
    body[4:6] = crc_of(bits_of(four[2:4]) + bits[:n]).to_bytes(2, "big")
    s = M.parse(bytes(body) * 3)
    assert (s.checked, s.failed, len(s.offsets)) == (3, 0, 3)
    body[6 + n // 16] ^= 0x10
    assert M.parse(bytes(body) * 3).failed == 3


def test_seek_points():
    media = M.pack(b"seek!" * 20_000)
    s = M.parse(media)
    assert len(s.vbr["toc"]) == 100 and s.vbr["toc"] == sorted(s.vbr["toc"]) and s.vbr["toc"][0] >= 0
    lead = s.offsets[0] - M.header(M._head(1, False)).size
    for p in range(0, 100, 7):  # a 256th of the stream is the table's precision
        frame = s.offsets[p * len(s.offsets) // 100]
        assert abs(lead + s.vbr["toc"][p] - frame) <= s.vbr["bytes"] / 256 + 1


def test_foreign_and_repeated_streams(spark):
    note = b"\x03payload\x00none of ours"
    frame = b"TXXX" + M._synchsafe(len(note)) + b"\0\0" + note
    foreign = b"ID3\x04\x00\x00" + M._synchsafe(len(frame)) + frame + (b"\xff\xfb\x90\x00" + bytes(413)) * 3
    own = M.pack(M.pad(b"text"), 4)
    df = spark.createDataFrame([(1, bytearray(foreign)), (1, bytearray(own)), (None, bytearray(own)), (1, bytearray(own))], "doc_id long, media binary")
    got = sorted(((r.doc_id, r.n_bytes, len(r.frame_offsets), r.duration) for r in M.index(df).collect()), key=repr)
    assert got == sorted([(1, None, 3, 3 * 1152 / 44100), (1, 4, 1, 1152 / 32000), (None, 4, 1, 1152 / 32000), (1, 4, 1, 1152 / 32000)], key=repr)


def test_frames_of_a_table(spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "x" * 200_000, "\0", "same", "same"]
    df = spark.createDataFrame([(i, t, b"x", "y") for i, t in enumerate(texts)], "doc_id long, text string, media binary, feature string")
    rows = {r.doc_id: r for r in M.index(M.store(df)).collect()}
    for i, t in enumerate(texts):
        check(rows[i], t)
        assert rows[i].rate == 32000 and rows[i].samples == 1152 * len(rows[i].frame_offsets)
    assert rows[7][1:] == rows[8][1:] and rows[0][1:] == rows[1][1:]
    assert M.index(M.store(df.limit(0))).count() == 0
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"no audio"))], "doc_id long, media binary")
    assert [(r.n_bytes, r.frame_offsets, r.samples) for r in M.index(odd).collect()] == [(None, [], 0)] * 2


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    got = registry.op5_mpeg_audio(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    for r in got:
        check(r, docs[r.doc_id])


def test_payload_that_looks_like_a_tag(spark):
    texts = ["TAG" * 40, "x" * 29 + "TAG" + "y" * 60]  # tail frame of 180 bytes: byte 29 of the text lies 128 before the end
    for n in (65, 128, 1400, 1417, 1480, 5000, 50_000):
        for shift in range(3):
            texts.append(("TAG" * (n // 3 + 2))[shift : shift + n])
    assert any(M.pack(M.pad(t.encode()))[-128:-125] == b"TAG" for t in texts[2:])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in M.index(M.store(df)).collect()}
    for i, t in enumerate(texts):
        check(rows[i], t)
    media = M.pack(M.pad(texts[0].encode()))
    tagged = media + b"TAG" + bytes(125)  # a tag of its own, after a payload that looks like one
    assert M.unpack(tagged)[0] == M.pad(texts[0].encode()) and M.parse(tagged).skipped == 0


def test_lost_payload_is_told(spark):
    media = M.pack(b"payload!" * 1000, 8000)
    with pytest.raises(ValueError):
        M.unpack(media[:-5])
    r = M.index(spark.createDataFrame([(1, bytearray(media[:-5]))], "doc_id long, media binary")).first()
    assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (None,) * 4 and len(r.frame_offsets) > 1
