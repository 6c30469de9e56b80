"""A payload that holds the bytes of an ID3v1 tag where a file's tag would be."""

import hashlib
import random
import struct

import pytest

from millrace.llm import mpeg_audio
from millrace.llm.common import Workspace


@pytest.mark.parametrize("n", [100, 200, 1000, 5000])
def test_a_tag_in_the_payload_is_payload(n):
    """TAG at every place of the payload, so also 128 bytes before the end, in the last frame or the one before."""
    for at in range(max(0, n - 200), n - 2):
        payload = mpeg_audio.text_payload("x" * at + "TAG" + "y" * (n - at - 3))[0]
        media = mpeg_audio.encode(payload)
        a = mpeg_audio.parse(media)
        assert hashlib.sha256(a.payload).digest() == hashlib.sha256(payload).digest() and not a.skipped and "title" not in a.tags
        assert len(a.offsets) == a.table["frames"]


def test_a_real_tag_stays_a_tag():
    payload = mpeg_audio.text_payload("z" * 300)[0]
    tag = b"TAG" + b"Song".ljust(30, b"\0") + bytes(95)
    a = mpeg_audio.parse(mpeg_audio.encode(payload) + tag)
    assert a.payload == payload and a.tags["title"] == "Song" and not a.skipped


def test_payloads_with_any_marker_come_back():
    """100,000 random payloads with tags, tables, sync bytes and whole files inside."""
    rng = random.Random(5)
    file = mpeg_audio.encode(b"q" * 64)
    marks = [b"TAG", b"ID3", b"ID3\x03\0\0\0\0\0\x7f", b"Xing", b"Info", b"VBRI", b"LAME", b"\xff\xfa\x54\xc0", b"\xff\xfb", b"\xff", b"\0" * 9, file, file[:300]]
    for _ in range(100_000):
        raw = b"".join(rng.choice(marks) if rng.random() < 0.5 else rng.randbytes(rng.randint(0, 70)) for _ in range(rng.randint(0, 5)))
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        a = mpeg_audio.parse(mpeg_audio.encode(payload, {"n_bytes": str(len(raw))}))
        assert a.payload == payload and a.tags["n_bytes"] == str(len(raw)) and not a.skipped and not a.crc_bad


@pytest.mark.parametrize("at", range(0, 140, 3))
def test_markers_at_every_offset_from_the_end(at):
    for mark in (b"TAG", b"ID3", b"Xing", b"\xff\xfa\x54\xc0"):
        for size in (64, 128, 192, 256, 1280):
            payload = bytearray(b"z" * size)
            payload[max(0, size - at - len(mark)) : max(0, size - at - len(mark)) + len(mark)] = mark
            payload = bytes(payload[:size])
            assert mpeg_audio.parse(mpeg_audio.encode(payload)).payload == payload


def frame(word: bytes, fill: bytes, good: bool = True) -> bytes:
    """A protected frame with a right or a wrong checksum."""
    h = mpeg_audio.header(word)
    body = (word + b"\0\0" + fill * h.length)[: h.length]
    c = mpeg_audio.checksum(body, h) ^ (not good)
    return body[:4] + c.to_bytes(2, "big") + body[6:]


def slow_crc(data: bytes, bits: int) -> int:
    c = 0xFFFF
    for i in range(bits):
        top = c >> 15 ^ (data[i // 8] >> (7 - i % 8) & 1)
        c = (c << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return c


@pytest.mark.parametrize("word, bits", [(b"\xff\xfe\x90\x00", 256), (b"\xff\xfe\x90\xc0", 128), (b"\xff\xfe\x90\x50", 32 * 4 + 8 * 4)])
def test_layer_one_checksums_cover_the_allocation(word, bits):
    f = frame(word, b"\x5a\x01")
    assert int.from_bytes(f[4:6], "big") == slow_crc(f[2:4] + f[6:], 16 + bits)
    a = mpeg_audio.parse(f + frame(word, b"\x11", False) + f)
    assert (a.crc_good, a.crc_bad, a.samples) == (2, 1, 3 * 384)


def test_layer_two_checksums_cover_allocation_and_selection():
    word = b"\xff\xfc\xa4\xc0"  # 192 kbps, 48000 Hz, one channel: 27 subbands
    # All allocations 0: 11 * 4 + 12 * 3 + 4 * 2 bits and no selection; all set: two bits more for each subband.
    for fill, bits in ((b"\0", 88), (b"\xff", 88 + 54)):
        f = frame(word, fill)
        assert int.from_bytes(f[4:6], "big") == slow_crc(f[2:4] + f[6:], 16 + bits)
    a = mpeg_audio.parse(frame(word, b"\x77") * 2 + frame(word, b"\x77", False))
    assert (a.crc_good, a.crc_bad, a.rate) == (2, 1, 48000)


def tag(version: int, flags: int, body: bytes, tail: bytes = b"") -> bytes:
    n = len(body)
    return b"ID3" + bytes([version, 0, flags, n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body + tail


def test_tag_headers():
    sound = mpeg_audio.encode(b"s" * 64)
    sound = sound[sound.index(b"\xff\xfa") :]
    text = b"\0Song"
    v3 = b"TIT2" + struct.pack(">I", len(text)) + b"\0\0" + text
    v4 = b"TIT2\0\0\0" + bytes([len(text), 0, 0]) + text
    for data in (
        tag(3, 0, v3), tag(4, 0, v4), tag(2, 0, b"TT2\0\0" + bytes([len(text)]) + text),
        tag(3, 0x40, struct.pack(">IHI", 6, 0, 0) + v3), tag(4, 0x40, bytes([0, 0, 0, 6, 1, 0]) + v4), tag(4, 0x10, v4, b"3DI\x04\0\x10\0\0\0\x10"),
    ):
        a = mpeg_audio.parse(data + sound)
        assert a.tags in ({"TIT2": "Song"}, {"TT2": "Song"}) and not a.skipped and len(a.offsets) == 1
    odd = b"\0a\xff\0b"  # written as FF 00 where unsynchronised
    v3 = b"TIT2" + struct.pack(">I", 4) + b"\0\0" + odd
    assert mpeg_audio.parse(tag(3, 0x80, v3) + sound).tags == {"TIT2": "a\u00ffb"}


def test_encoder_delay_and_seek_points():
    word = b"\xff\xfb\x94\xc0"  # 128 kbps, 48000 Hz, one channel, no checksum
    n = mpeg_audio.header(word).length
    info = b"Info" + struct.pack(">II", 1, 2) + b"LAME3.100".ljust(21, b"\0") + (576 << 12 | 1000).to_bytes(3, "big")
    a = mpeg_audio.parse((word.ljust(21, b"\0") + info).ljust(n, b"\0") + word.ljust(n, b"\0") * 2)
    assert (a.delay, a.padding, a.samples, a.table["encoder"]) == (576, 1000, 2304, "LAME3.100")
    h = mpeg_audio.header(b"\xff\xfb\x94\xc0")
    points = struct.pack(">4s3H2I4H", b"VBRI", 1, 0, 9, 5000, 3, 2, 10, 2, 1) + struct.pack(">2H", 7, 8)
    first = (b"\xff\xfb\x94\xc0".ljust(36, b"\0") + points).ljust(h.length, b"\0")
    a = mpeg_audio.parse(first + b"\xff\xfb\x94\xc0".ljust(h.length, b"\0") * 3)
    assert a.table["toc"] == [70, 150] and a.table["frames"] == 3 and len(a.offsets) == 3


def test_columns_named_like_the_outputs_stay(spark):
    files = mpeg_audio.store_texts(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), Workspace(spark, "t"))
    out = mpeg_audio.audio_columns(files.selectExpr("doc_id", "media", "'x' AS rate", "'y' AS Rate_in", "7 AS frames"))
    assert {r.frames_in for r in out.collect()} == {7} and out.where("rate = 48000").count() == 2
    assert set(out.select("rate_in_in", "Rate_in").first()) == {"x", "y"}
