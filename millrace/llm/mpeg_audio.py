"""MPEG audio as a column: frames, tags, variable-bitrate tables and seek offsets.

``parse`` reads any of MPEG 1, 2 and 2.5, layers I to III: it reads ID3 tags
(extended headers, unsynchronisation and footers too), finds the first frame
(and the next after damage) by a header whose successor has a fitting header
too, follows frame lengths, checks the CRC of protected frames, reads a Xing,
Info or VBRI table with its seek points and an encoder's delay and padding, and
returns the exact duration in samples and the byte offset of each frame.

``encode`` stores bytes losslessly in valid layer III frames: side information
of zeros leaves the whole main data area of a (silent) frame to ancillary data,
and that is where the payload goes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, ship, table

# Fixed values of the MPEG audio header.
_KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_RATES = {1.0: (44100, 48000, 32000), 2.0: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
_VERSIONS = {0: 2.5, 2: 2.0, 3: 1.0}


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    kbps: int
    rate: int
    padding: int
    mode: int
    extension: int

    @property
    def mono(self) -> bool:
        return self.mode == 3

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 576 if self.layer == 3 and self.version > 1 else 1152

    @property
    def length(self) -> int:
        if self.layer == 1:
            return (12 * self.kbps * 1000 // self.rate + self.padding) * 4
        return self.samples // 8 * self.kbps * 1000 // self.rate + self.padding

    @property
    def side(self) -> int:
        """Bytes of side information (layer III)."""
        if self.version == 1:
            return 17 if self.mono else 32
        return 9 if self.mono else 17

    @property
    def body(self) -> int:
        """Where a layer III frame's main data area begins."""
        return 4 + 2 * self.protected + self.side


@lru_cache(4096)
def header(word: bytes) -> Header | None:
    """The header in four bytes, or None if they can't be one."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = _VERSIONS.get(word[1] >> 3 & 3), 4 - (word[1] >> 1 & 3)
    bitrate, rate = word[2] >> 4, word[2] >> 2 & 3
    if version is None or layer == 4 or bitrate in (0, 15) or rate == 3 or word[3] & 3 == 2:
        return None
    return Header(version, layer, not word[1] & 1, _KBPS[min(2, int(version)), layer][bitrate], _RATES[version][rate], word[2] >> 1 & 1, word[3] >> 6, word[3] >> 4 & 3)


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        out.append(c & 0xFFFF)
    return out


_CRC = _crc_table()


@lru_cache(4096)
def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFF00) ^ _CRC[(c >> 8) ^ b]
    return c


# Fixed values of layer II: runs of (subbands, bits of an allocation) by table.
_ALLOCATION = {
    "wide": ((11, 4), (12, 3), (4, 2)),
    "full": ((11, 4), (12, 3), (7, 2)),
    "low": ((2, 4), (6, 3)),
    "low32": ((2, 4), (10, 3)),
    "half": ((4, 4), (7, 3), (19, 2)),
}


def _allocation(h: Header) -> list[int]:
    """Bits of the allocation of each subband of a layer II frame."""
    each = h.kbps if h.mono else h.kbps // 2
    if h.version > 1:
        kind = "half"
    elif each <= 48:
        kind = "low32" if h.rate == 32000 else "low"
    else:
        kind = "wide" if each <= 80 or h.rate == 48000 else "full"
    return [bits for many, bits in _ALLOCATION[kind] for _ in range(many)]


def _bits(data: bytes, at: int, n: int) -> int:
    """``n`` bits from bit ``at`` on; beyond the end they are 0."""
    first, last = at // 8, -(-(at + n) // 8)
    return int.from_bytes(data[first:last].ljust(last - first, b"\0"), "big") >> (8 * last - at - n) & ((1 << n) - 1)


def _guarded_bits(frame: bytes, h: Header) -> int:
    """How many bits after the checksum it covers."""
    if h.layer == 3:
        return 8 * h.side
    channels = 1 if h.mono else 2
    widths = [4] * 32 if h.layer == 1 else _allocation(h)
    joint = min(len(widths), 4 * h.extension + 4) if h.mode == 1 else len(widths)
    own = [(w, channels if i < joint else 1) for i, w in enumerate(widths)]
    total = sum(w * c for w, c in own)
    if h.layer == 2:  # two bits of scale factor selection for each channel of a subband that has samples
        at = 48
        for w, c in own:
            held = [_bits(frame, at + i * w, w) > 0 for i in range(c)]
            total += 2 * (sum(held) if c == channels else channels * held[0])
            at += w * c
    return total


def checksum(frame: bytes, h: Header) -> int:
    """The CRC that a protected frame should have."""
    n = _guarded_bits(frame, h)
    c = crc16(frame[2:4] + frame[6 : 6 + n // 8])
    for i in range(n // 8 * 8, n):
        top = c >> 15 ^ _bits(frame, 48 + i, 1)
        c = (c << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return c


@dataclass
class Audio:
    tags: dict[str, str] = field(default_factory=dict)
    table: dict = field(default_factory=dict)
    rate: int = 0
    samples: int = 0
    offsets: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    kbps: set[int] = field(default_factory=set)
    crc_good: int = 0
    crc_bad: int = 0
    skipped: int = 0
    #: Samples that the encoder put before and after the sound.
    delay: int = 0
    padding: int = 0
    payload: bytes = b""


def _text(raw: bytes) -> str:
    if not raw:
        return ""
    kind, body = raw[0], raw[1:]
    return body.decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(kind, "latin-1"), "replace")


def _plain(b: bytes) -> int:
    return int.from_bytes(b, "big")


def _synch(b: bytes) -> int:
    """An integer of seven bits a byte."""
    out = 0
    for x in b:
        out = out << 7 | x & 127
    return out


def _id3v2(data: bytes) -> tuple[dict[str, str], int]:
    """Text frames of a leading ID3v2 tag (2.2 to 2.4), and where it ends."""
    if len(data) < 10 or data[:3] != b"ID3" or data[3] not in (2, 3, 4):
        return {}, 0
    version, flags = data[3], data[5]
    end = 10 + _synch(data[6:10])
    body = data[10:end]
    end = min(len(data), end + 10 * (version == 4 and flags >> 4 & 1))
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    at = 0
    if flags & 0x40 and version > 2:  # its size includes itself in 2.4 only
        at = _synch(body[:4]) if version == 4 else 4 + _plain(body[:4])
    key, head = (3, 6) if version == 2 else (4, 10)
    tags: dict[str, str] = {}
    while at + head <= len(body) and body[at]:
        name = body[at : at + key].decode("latin-1")
        n = (_synch if version == 4 else _plain)(body[at + key : at + (6 if version == 2 else 8)])
        part, how = body[at + head : at + head + n], body[at + 9] if version == 4 else 0
        if how & 1:  # a length before the data
            part = part[4:]
        if how & 2 or version == 4 and flags & 0x80:
            part = part.replace(b"\xff\0", b"\xff")
        if name in ("TXXX", "TXX"):
            own, _, value = _text(part).partition("\0")
            tags[own] = value.rstrip("\0")
        elif name.startswith("T"):
            tags[name] = _text(part).rstrip("\0")
        at += head + n
    return tags, end


def _table_of(frame: bytes, h: Header) -> dict:
    """A Xing, Info or VBRI table in a first frame; ``toc`` holds its seek points."""
    at = h.body
    if h.layer == 3 and frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
        out: dict = {"kind": frame[at : at + 4].decode()}
        flags, at = _plain(frame[at + 4 : at + 8]), at + 8
        for bit, key, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit and len(frame) >= at + n:
                part = frame[at : at + n]
                out[key] = list(part) if key == "toc" else _plain(part)
                at += n
        if frame[at : at + 4] in (b"LAME", b"Lavc", b"Lavf") and len(frame) >= at + 24:
            both = _plain(frame[at + 21 : at + 24])
            out |= {"encoder": frame[at : at + 9].decode("latin-1").rstrip("\0 "), "delay": both >> 12, "padding": both & 0xFFF}
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames = struct.unpack(">II", frame[46:54])
        count, scale, width, step = struct.unpack(">4H", frame[54:62])
        toc, upto = [], 0
        for i in range(count if 1 <= width <= 4 and len(frame) >= 62 + count * width else 0):
            upto += scale * _plain(frame[62 + i * width : 62 + (i + 1) * width])
            toc.append(upto)
        return {"kind": "VBRI", "bytes": size, "frames": frames, "frames_a_point": step, "toc": toc}
    return {}


def _like(a: Header, b: Header | None) -> bool:
    return b is not None and (a.version, a.layer, a.rate) == (b.version, b.layer, b.rate)


def _reaches_end(data: bytes, at: int) -> bool:
    """Whether fitting frames follow one another from ``at`` to the very end."""
    h = first = header(data[at : at + 4])
    while _like(first, h) and at + h.length < len(data):
        at += h.length
        h = header(data[at : at + 4])
    return _like(first, h) and at + h.length == len(data)


def parse(data: bytes) -> Audio:
    """Everything a file says; damaged or strange stretches are skipped and counted."""
    out = Audio()
    out.tags, at = _id3v2(data)
    end = len(data)
    tag = end >= 128 and data[end - 128 : end - 125] == b"TAG"
    if tag:
        end -= 128
    bodies, first = [], True
    synced = False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h is not None and at + h.length > end:
            if synced and tag and _reaches_end(data, at):  # what looked like a tag is a frame's data
                end, tag = len(data), False
            else:
                h = None
        if h is not None and not synced:
            after = at + h.length
            if after != end and not _like(h, header(data[after : after + 4])):
                h = None
        if h is None:
            synced = False
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.skipped += nxt - at
            at = nxt
            continue
        synced = True
        frame = data[at : at + h.length]
        if h.protected and len(frame) >= (h.body if h.layer == 3 else 6):
            good = checksum(frame, h) == _plain(frame[4:6])
            out.crc_good += good
            out.crc_bad += not good
        if first and (found := _table_of(frame, h)):
            out.table = found
            out.delay, out.padding = found.get("delay", 0), found.get("padding", 0)
        else:
            out.rate = out.rate or h.rate
            out.samples += h.samples
            out.offsets.append(at)
            out.lengths.append(h.length)
            out.kbps.add(h.kbps)
            bodies.append(frame[h.body :])
        first = False
        at += h.length
    out.skipped += max(0, end - at)
    if tag:
        out.tags.setdefault("title", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    size = out.tags.get("payload_bytes", "")
    out.payload = b"".join(bodies)[: int(size) if size.isdigit() else None]
    return out


# --- writing ----------------------------------------------------------------

_RATE, _SIDE = 48000, bytes(17)
#: Bytes of files that a worker sends back at once (a longer file goes alone).
WRITE_BYTES = 1_000_000


@lru_cache(16)
def _head(kbps: int) -> tuple[bytes, int]:
    """Header, CRC and empty side information of a mono layer III frame, and its room."""
    word = bytes([0xFF, 0xFA, _KBPS[1, 3].index(kbps) << 4 | 1 << 2, 0xC0])
    return word + crc16(word[2:4] + _SIDE).to_bytes(2, "big") + _SIDE, 144 * kbps * 1000 // _RATE - 6 - len(_SIDE)


def _tag(values: dict[str, str]) -> bytes:
    body = b""
    for k, v in values.items():
        text = b"\x03" + k.encode() + b"\0" + v.encode()
        body += b"TXXX" + struct.pack(">I", len(text)) + b"\0\0" + text
    n = len(body)
    return b"ID3\x03\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body


def encode(payload: bytes, tags: dict[str, str] | None = None) -> bytes:
    """``payload`` as a variable-bitrate file: tag, Xing frame, frames."""
    sizes = [(k, _head(k)[1]) for k in _KBPS[1, 3][1:]]
    top, room = sizes[-1]
    frames, at = [], 0
    while at < len(payload) or not frames:
        left = len(payload) - at
        kbps, fits = (top, room) if left >= room else next(s for s in sizes if s[1] >= left)
        frames.append(_head(kbps)[0] + payload[at : at + fits].ljust(fits, b"\0"))
        at += fits
    head, fits = _head(48)
    total = sum(map(len, frames)) + len(head) + fits
    toc, done, ends = [], 0, []
    for f in frames:
        ends.append(done)
        done += len(f)
    for i in range(100):
        toc.append(min(255, 256 * (ends[i * len(frames) // 100] + len(head) + fits) // total))
    xing = b"Xing" + struct.pack(">III", 15, len(frames), total) + bytes(toc) + struct.pack(">I", 100)
    return _tag({"payload_bytes": str(len(payload)), **(tags or {})}) + head + xing.ljust(fits, b"\0") + b"".join(frames)


def text_payload(text: str | None, unit: int = 64) -> tuple[bytes, int]:
    """UTF-8 bytes of a text, zero-padded to a positive multiple of ``unit``; and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % unit or (0 if raw else unit)), len(raw)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column(0), b.column(1)
        i = 0
        while i < b.num_rows:
            j, held, media = i, 0, []
            while j < b.num_rows and held < WRITE_BYTES:
                payload, n = text_payload(texts[j].as_py())
                media.append(encode(payload, {"n_bytes": str(n)}))
                held += len(media[-1])
                j += 1
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(media, pa.binary())], ["doc_id", "media"])
            i = j


def store_texts(docs: DataFrame, space: Workspace, name: str = "media") -> DataFrame:
    """Write every whole text of ``docs(doc_id, text)`` as an audio file (doc_id, media).

    A null text counts as empty; a null doc_id stays null; repeated rows stay.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return space.put(rows.mapInArrow(_store, "doc_id long, media binary"), name)


INFO = "rate int, samples long, duration_s double, frames long, vbr_table string, crc_good long, crc_bad long, skipped long, tags map<string,string>, frame_offsets array<long>"


def _info(a: Audio) -> dict:
    return {
        "rate": a.rate, "samples": a.samples, "duration_s": max(0, a.samples - a.delay - a.padding) / a.rate if a.rate else 0.0, "frames": len(a.offsets), "vbr_table": a.table.get("kind"),
        "crc_good": a.crc_good, "crc_bad": a.crc_bad, "skipped": a.skipped, "tags": list(a.tags.items()), "frame_offsets": a.offsets,
    }


def audio_columns(files: DataFrame, media: str = "media") -> DataFrame:
    """``files`` with what ``parse`` finds in its binary column; a null one gives nulls.

    ``duration_s`` leaves out the samples that the encoder's delay and padding
    say are not sound. An input column whose name (in any case) is one of these
    outputs stays, with ``_in`` put behind its name, once more while that is taken.
    """
    ship(files.sparkSession)
    names = [f.strip().split(" ")[0] for f in INFO.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.list_(pa.int64())]
    taken = {c.lower() for c in [*names, *files.columns]}
    own = []
    for c in files.columns:
        name = c
        while c.lower() in names and name.lower() in taken:
            name += "_in"
        taken.add(name.lower())
        own.append(name)
    at = files.columns.index(media)
    files = files.toDF(*own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [None if (m := x.as_py()) is None else _info(parse(m)) for x in b.column(at)]
            more = [pa.array([None if r is None else r[n] for r in rows], k) for n, k in zip(names, kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*own, *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema] + [INFO])
    return files.mapInArrow(run, schema)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[] for _ in range(7)]
        for x in b.column(1):
            media = x.as_py()
            a = parse(media)
            p = a.payload
            seek = zlib.crc32(struct.pack(f"<{len(a.offsets)}Q", *a.offsets))
            feature = f"rate={a.rate};samples={a.samples};frames={len(a.offsets)};kbps={min(a.kbps)}-{max(a.kbps)};table={a.table.get('kind')}:{a.table.get('frames')};crc={a.crc_good}/{a.crc_good + a.crc_bad};skipped={a.skipped};seek={seek:08x}"
            for o, v in zip(out, (int(a.tags["n_bytes"]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature)):
                o.append(v)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(o, k) for o, k in zip(out, kinds)]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def op3_mpeg_audio(spark, sf_dir):
    return store_texts(table(spark, sf_dir, "documents"), Workspace(spark, "media")).mapInArrow(_digest, DIGEST)
