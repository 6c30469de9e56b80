"""Token ids in patched frame-of-reference blocks.

A segment holds the ids of whole documents. Its ids are cut into blocks of 256;
a block stores its minimum, the differences packed at the width that fits a
chosen percentile of them, and the high bits of the few that are wider in an
exception list. Block starts, widths and exception starts are arrays at the
front, so any range of ids is read by decoding its blocks alone.

Segment layout, little-endian: ``PFR1``, then u32 documents, ids, blocks;
u64 document starts [documents + 1]; u32 minima [blocks]; u8 widths [blocks];
u32 block starts in 8-byte words [blocks + 1]; u32 exception starts [blocks + 1];
the packed words; u32 high bits of the exceptions; u8 places of the exceptions.
"""

from __future__ import annotations

import os
import string
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, ship, shuffle_parts, table
from .words import WORKER_CACHES, slices, span_hashes

BLOCK, PERCENTILE, SEGMENT_IDS = 256, 0.9, 1 << 18
END_ID = 0
_HEAD = struct.Struct("<4sIII")
_U64 = np.uint64


# --- blocks -----------------------------------------------------------------


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 256) values below 2**width -> (blocks, 4 * width) 64-bit words."""
    v = values.reshape(-1, 64)
    out = np.zeros((len(v), width), _U64)
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        out[:, word] |= v[:, j] << _U64(shift)
        if shift + width > 64:
            out[:, word + 1] |= v[:, j] >> _U64(64 - shift)
    return out.reshape(len(values), 4 * width)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    w = words.reshape(-1, width) if width else words
    out = np.zeros((len(words) * 4, 64), _U64)
    mask = _U64((1 << width) - 1)
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        v = w[:, word] >> _U64(shift)
        if shift + width > 64:
            v = v | (w[:, word + 1] << _U64(64 - shift))
        out[:, j] = v & mask
    return out.reshape(-1, BLOCK)


_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    high = values >> np.uint32(16)
    if not high.any():
        return _BITS[values]
    return np.where(high > 0, _BITS[high] + np.uint8(16), _BITS[values & np.uint32(0xFFFF)])


def encode_segment(ids: np.ndarray, doc_starts: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One segment of unsigned 32-bit ``ids``; ``doc_starts`` ends with their number."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    if n:
        padded[n:] = padded[n - 1]
    padded = padded.reshape(blocks, BLOCK)
    low = padded.min(axis=1) if n else np.empty(0, np.uint32)
    diff = padded - low[:, None]
    bits = _bit_lengths(diff)
    at = min(BLOCK - 1, max(0, int(np.ceil(percentile * BLOCK)) - 1))
    widths = np.partition(bits, at, axis=1)[:, at] if n else np.empty(0, np.uint8)
    starts = np.zeros(blocks + 1, np.uint32)
    np.cumsum(4 * widths.astype(np.uint32), out=starts[1:])
    words = np.empty(int(starts[-1]), _U64)
    for w in np.unique(widths).tolist():
        own = np.flatnonzero(widths == w)
        if w:
            places = starts[own][:, None] + np.arange(4 * w, dtype=np.uint32)
            words[places] = _pack(diff[own].astype(_U64) & _U64((1 << w) - 1), w)
    over = bits > widths[:, None]
    which, where = np.nonzero(over)
    first = np.zeros(blocks + 1, np.uint32)
    np.cumsum(np.bincount(which, minlength=blocks), out=first[1:])
    high = (diff[which, where].astype(_U64) >> widths[which].astype(_U64)).astype("<u4")
    return b"".join(
        [
            _HEAD.pack(b"PFR1", len(doc_starts) - 1, n, blocks), np.asarray(doc_starts, "<u8").tobytes(), low.astype("<u4").tobytes(), widths.tobytes(),
            starts.astype("<u4").tobytes(), first.astype("<u4").tobytes(), words.astype("<u8").tobytes(), high.tobytes(), where.astype(np.uint8).tobytes(),
        ]
    )


class Segment:
    """A written segment; ``ids(a, b)`` decodes only the blocks of that range."""

    def __init__(self, data: bytes) -> None:
        magic, docs, self.n, blocks = _HEAD.unpack_from(data)
        if magic != b"PFR1":
            raise ValueError("not a token segment")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.doc_starts = take("<u8", docs + 1).astype(np.int64)
        self.low, self.widths = take("<u4", blocks), take("u1", blocks)
        self.starts, self.first = take("<u4", blocks + 1), take("<u4", blocks + 1)
        self.words = take("<u8", int(self.starts[-1]))
        exceptions = int(self.first[-1])
        self.high, self.places = take("<u4", exceptions), take("u1", exceptions)

    def ids(self, a: int = 0, b: int | None = None) -> np.ndarray:
        b = self.n if b is None else b
        if a >= b:
            return np.empty(0, np.uint32)
        x, y = a // BLOCK, -(-b // BLOCK)
        widths = self.widths[x:y]
        out = np.zeros((y - x, BLOCK), np.uint32)
        for w in np.unique(widths).tolist():
            if w:
                own = np.flatnonzero(widths == w)
                places = self.starts[x:y][own].astype(np.int64)[:, None] + np.arange(4 * w)
                out[own] = _unpack(self.words[places], w)
        e, f = int(self.first[x]), int(self.first[y])
        which = np.repeat(np.arange(y - x), np.diff(self.first[x : y + 1].astype(np.int64)))
        out[which, self.places[e:f]] |= (self.high[e:f].astype(_U64) << widths[which].astype(_U64)).astype(np.uint32)
        out += self.low[x:y, None]
        return out.reshape(-1)[a - x * BLOCK : b - x * BLOCK]


# --- tokens -----------------------------------------------------------------

_MARKS = string.punctuation.encode()


def _byte_letters() -> dict[int, str]:
    """The printable stand-in that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True
#: First bytes of characters among which there are blanks beyond ASCII.
_DOUBT = np.zeros(256, bool)
_DOUBT[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def units(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pieces begin that the byte-level vocabularies encode independently.

    Their splitting rule never joins a blank to what stands before it, and lets
    the last blank before a word begin the word's piece. So a text may be cut
    before a space that a word follows, and before a line break that follows a
    word. Where a blank beyond ASCII may be involved, there is no cut.
    """
    n = len(raw)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        here, nxt = raw[:-1], raw[1:]
        cut[: n - 1] = (here == 32) & ~_BLANK[nxt] & ~_DOUBT[nxt]
        word_before = ~_BLANK[here] & (here < 128)
        word_before[1:] |= (here[1:] >= 128) & (here[:-1] == 0xC3)
        cut[1:n] |= (nxt == 10) & word_before
    cut[off] = True
    cut[n] = False
    return np.flatnonzero(cut)


_PACKERS = [struct.Struct(f"<{k}I") for k in range(17)]


def _little(ids: list[int]) -> bytes:
    return _PACKERS[len(ids)].pack(*ids) if len(ids) < 17 else struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Byte-level BPE of whole texts, each different word of a batch once.

    A word of letters is one piece of the vocabulary's splitting rule, and so is
    a run of marks after it; these go straight to the library's BPE model, anything
    else through the library's whole pipeline. ``remember`` words are kept in
    each of two generations; beyond that the older generation goes, so memory
    is bounded whatever the words are.
    """

    def __init__(self, path: str, remember: int = 300_000, longest: int = 64) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        #: Strings that the library takes out of a text before it splits the rest.
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.remember, self.longest = remember, longest
        self.line = _little(self.tok.encode("\n", add_special_tokens=False).ids)
        self.marks: dict[bytes, bytes] = {}

    def _letters(self, lead: int, word: bytes) -> bytes:
        """A word of letters after a space, a line break or nothing."""
        piece = word.decode("ascii") if word.isascii() else word.decode("latin-1").translate(_LETTERS)
        tokens = self.model.tokenize("\u0120" + piece if lead == 32 else piece)
        ids = _little([t.id for t in tokens])
        return self.line + ids if lead == 10 else ids

    def _unit(self, unit: bytes) -> bytes | None:
        """The ids of a unit, or None if it takes the whole pipeline."""
        lead = unit[0]
        word = unit[1:] if lead in (32, 10) else unit
        # isalpha() of bytes knows ASCII letters alone, and spares decoding most words.
        if word.isalpha() or (not word.isascii() and word.decode("utf-8").isalpha()):
            return self._letters(lead, word)
        stem = word.rstrip(_MARKS)
        if stem != word and (stem.isalpha() or (not stem.isascii() and stem.decode("utf-8").isalpha())):
            marks = word[len(stem) :]
            tail = self.marks.get(marks)
            if tail is None:
                if len(self.marks) > 10_000:
                    self.marks.clear()
                tail = self.marks[marks] = _little(self.tok.encode(marks.decode(), add_special_tokens=False).ids)
            key = unit[: len(unit) - len(marks)]
            ids = self.new.get(key) or self.old.get(key)
            if ids is None:
                ids = self.new[key] = self._letters(lead, stem)
            return ids + tail
        return None

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their number by text) of texts in one buffer."""
        starts = units(raw, off)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        data = raw.tobytes()
        if any(s in data for s in self.special):
            of = np.searchsorted(off, starts, "right") - 1
            odd = np.array([any(s in data[a:b] for s in self.special) for a, b in zip(off[:-1].tolist(), off[1:].tolist())])
            starts = starts[~odd[of] | (starts == off[of])]
        first = np.searchsorted(starts, off)
        ends = np.append(starts[1:], len(raw))
        key = span_hashes(raw, starts, ends)
        _, where, which = np.unique(key, return_index=True, return_inverse=True)
        # Words of one hash must also agree in length and byte sum; if ever two differ, each place is its own word.
        second = np.add.reduceat(raw, starts, dtype=np.int64) * (1 << 32) + (ends - starts)
        if (second[where][which] != second).any():
            where, which = np.arange(len(key)), np.arange(len(key))
        if len(self.new) > self.remember:
            self.old, self.new = self.new, {}
        new, old, found, rest = self.new, self.old, [], []
        for k, (a, b) in enumerate(zip(starts[where].tolist(), ends[where].tolist())):
            unit = data[a:b]
            ids = new.get(unit)
            if ids is None:
                ids = old.get(unit) or (None if any(s in unit for s in self.special) else self._unit(unit))
                if ids is None:
                    rest.append(k)
                    found.append(unit)
                    continue
                if b - a <= self.longest:
                    new[unit] = ids
            found.append(ids)
        for k, e in zip(rest, self.tok.encode_batch_fast([found[k].decode("utf-8") for k in rest], add_special_tokens=False)):
            unit, found[k] = found[k], _little(e.ids)
            if len(unit) <= self.longest:
                new[unit] = found[k]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        begin = np.cumsum(size) - size
        count = size[which]
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = flat[np.arange(upto[-1]) + np.repeat(begin[which] - upto[:-1], count)]
        return ids, np.diff(upto[first])


_ENCODERS: dict[str, Encoder] = {}
WORKER_CACHES.append(_ENCODERS)


def encoder(path: str) -> Encoder:
    """One per Python worker; a reused worker keeps its words."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# --- the store --------------------------------------------------------------

#: Text bytes that are encoded at once.
BATCH_BYTES = 8 << 20
SEGMENTS = "shard int, seq long, n_ids long, doc_ids array<bigint>, data binary"


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches joined to tables of about ``most`` bytes, so that a word is looked up once in each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _writer(path: str, end_id: int, segment_ids: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seq = TaskContext.get().partitionId(), 0
        docs: list = []
        parts: list[np.ndarray] = []
        sizes: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, docs, parts, sizes, held
            starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            data = encode_segment(np.concatenate(parts), starts)
            row = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([seq], pa.int64()), pa.array([int(starts[-1])], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([data], pa.binary())],
                ["shard", "seq", "n_ids", "doc_ids", "data"],
            )
            seq, docs, parts, sizes, held = seq + 1, [], [], [], 0
            return row

        tok = encoder(path)
        for batch in _gathered(batches, BATCH_BYTES):
            own = batch.column(0).to_pylist()
            for i, j, raw, off in slices(batch.column(1), BATCH_BYTES):
                ids, count = tok.encode(raw, off)
                ids = np.insert(ids, np.cumsum(count), np.uint32(end_id))
                ends = np.cumsum(count + 1)
                a = at = 0
                for d in range(j - i):
                    b = int(ends[d])
                    docs.append(own[i + d])
                    sizes.append(b - at)
                    held += b - at
                    at = b
                    if held >= segment_ids:
                        parts.append(ids[a:b])
                        a = b
                        yield flush()
                if at > a:
                    parts.append(ids[a:at])
        if docs:
            yield flush()

    return write


def write_tokens(docs: DataFrame, path: str, space: Workspace, name: str = "tokens", end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encode whole texts and write segments in ascending doc_id order.

    Shards are ranges of doc_id (null first), segments are ordered in a shard,
    and every document, a null or empty one too, ends with ``end_id``. Rows that
    repeat a doc_id are stored each, ordered by text. Returns the written table.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(shuffle_parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return space.put(rows.mapInArrow(_writer(path, end_id, segment_ids), SEGMENTS), name, compression="none")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, seq, docs, data in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            seg = Segment(data)
            ids = seg.ids().astype("<u4")
            s = seg.doc_starts
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(s[:-1], s[1:])]
            n = len(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * n, pa.int32()), pa.array([seq] * n, pa.int64()), pa.array(docs, pa.int64()), pa.array(s[:-1]), pa.array(np.diff(s)), pa.array(crc, pa.int64())],
                ["shard", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_tokens(segments: DataFrame) -> DataFrame:
    """Per document, from the stored segments: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it: ids of earlier shards
    (one total a shard), of earlier segments of its shard, and of its segment.
    """
    ship(segments.sparkSession)
    inner = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_ids")
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))
    outer = F.sum("shard_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("shard_ids")
    starts = segments.select("shard", "seq", inner.alias("inner")).join(shards.select("shard", outer.alias("outer")), "shard")
    read = segments.select("shard", "seq", "doc_ids", "data").mapInArrow(_reader, "shard int, seq long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["shard", "seq"]).select("doc_id", (F.col("outer") + F.col("inner") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def store(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``docs`` as token segments and return what reading them back gives."""
    return read_tokens(write_tokens(docs, path or vocabulary(), Workspace(docs.sparkSession, "tokens")))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(table(spark, sf_dir, "documents"))
