"""Vectorised word, shingle and window hashing over Arrow string columns.

A batch of texts is one contiguous UTF-8 buffer plus offsets; everything here
works on that buffer with numpy, so no Python object is made for a word.

A word's hash is a polynomial of its bytes modulo 2**64 taken from one prefix
sum (prefix difference, shifted back by the inverse power of the base), then
finalised with a 64-bit mixer. Two independent families (``seed`` 0 and 1)
give 128 bits where an exact comparison is stood in for by hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Largest number of text bytes hashed at once (one longer text is taken alone).
SLICE_BYTES = (1 << 19) - 1

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLAIN = np.arange(256, dtype=np.uint8)
_PUNCT = _SPACE.copy()
_PUNCT[:128] = True
_PUNCT[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False

_GOLD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), vectorised."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers of family ``seed``."""
    start = (seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & _MASK
    x = (np.arange(1, n + 1, dtype=U64) * U64(_GOLD)) + U64(start)
    return mix64(x) | U64(1)


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, seed: int) -> None:
        self.base = int(constants(1, 100 + seed)[0]) | 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.values = constants(256, 200 + seed)
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            up, down = pow(self.base, k, 1 << 64), pow(self.inverse, k, 1 << 64)
            self.up = np.concatenate([self.up, self.up * U64(up)])
            self.down = np.concatenate([self.down, self.down * U64(down)])
        return self.up, self.down


_POWERS = {s: _Powers(s) for s in (0, 1)}


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(off):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``most`` bytes."""
    raw, off = text_buffer(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of byte spans, in ascending order; equal bytes give equal hashes wherever they stand.

    Long buffers are taken in stretches of about ``SLICE_BYTES`` (one longer span alone).
    """
    if len(raw) <= 2 * SLICE_BYTES or not len(starts):
        return _span_hashes(raw, starts, ends, seed)
    out, i = np.empty(len(starts), U64), 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + SLICE_BYTES, "right")))
        out[i:j] = _span_hashes(raw[at : ends[j - 1]], starts[i:j] - at, ends[i:j] - at, seed)
        i = j
    return out


def _span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    p = _POWERS[seed]
    n = len(raw)
    up, down = p.upto(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(p.values[raw] * up[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix64(h + (ends - starts).astype(U64) * U64(_GOLD))


#: What operators remember from task to task in a Python worker. A worker that is
#: reused for another operator gives it up, so that memories don't add up.
WORKER_CACHES: list[dict] = []


def trim_memory() -> None:
    """Return freed memory to the system; allocators would keep it until the worker ends."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def give_up_caches() -> None:
    held = [c for c in WORKER_CACHES if c]
    for cache in held:
        cache.clear()
    if held:
        trim_memory()


class Words:
    """The words of some texts: byte spans, the text of each, and hashes.

    ``lower`` folds A-Z; ``punct`` also splits at every ASCII character that is
    neither a letter nor a digit.
    """

    def __init__(self, raw: np.ndarray, off: np.ndarray, lower: bool = True, punct: bool = False) -> None:
        give_up_caches()
        self.raw, self.off, self.texts = raw, off, len(off) - 1
        self.folded = _LOWER[raw] if lower else raw
        n = len(raw)
        inside = ~(_PUNCT if punct else _SPACE)[raw]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.empty(n + 1, bool)
        before[0], before[1:] = False, inside
        self.starts = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
        after = np.empty(n + 1, bool)
        after[:-1], after[-1] = inside, False
        self.ends = np.flatnonzero(inside & (~after[1:] | edge[1:])) + 1
        #: first word of each text, and the end
        self.first = np.searchsorted(self.starts, off)
        self.counts = np.diff(self.first)
        self.n = len(self.starts)

    def of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(self.texts), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return span_hashes(self.folded, self.starts, self.ends, seed)

    def runs(self, hashes: np.ndarray, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``width`` words inside one text, and their first words."""
        m = self.n - width + 1
        if m <= 0:
            return np.empty(0, U64), np.empty(0, np.int64)
        c = constants(width, 300 + seed)
        h = hashes[:m] * c[0]
        for j in range(1, width):
            h += hashes[j : j + m] * c[j]
        of = self.of()
        at = np.flatnonzero(of[:m] == of[width - 1 :])
        return mix64(h[at]), at


def shingle_sets(words: Words, width: int = 5, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (hashes sorted within a text, offsets by text).

    A text with 1 to ``width`` - 1 words has its whole word sequence as its one
    shingle; a text without words has none.
    """
    wh = words.hashes(seed)
    h, at = words.runs(wh, width, seed)
    of = words.of()[at] if len(at) else np.empty(0, np.int64)
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):
        extra = np.empty(len(short), U64)
        for i, d in enumerate(short):
            part = wh[words.first[d] : words.first[d + 1]]
            with np.errstate(over="ignore"):
                extra[i] = (part * constants(len(part), 400 + 10 * len(part) + seed)).sum(dtype=U64)
        h, of = np.concatenate([h, mix64(extra)]), np.concatenate([of, short])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(words.texts + 1))
