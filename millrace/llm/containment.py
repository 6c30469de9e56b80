"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are few and short, documents many and long, so their Jaccard
similarity says little. Items are partitioned by their number of shingles into
classes of powers of two. For a class of at most u shingles each document is
seen as blocks of 2u shingles, one every u, so that a copy of an item lies
inside one block and containment t becomes a Jaccard similarity of at least
t*q / (2u + (1-t)*q) > 0.18 between item (q > u/2) and block. With ``HASHES``
MinHash functions, a pair is a candidate if one of their minima agrees: a copy
at the very threshold is missed with probability below 0.82**64 < 4e-6. The
minima of a block come from its two halves, and those of a class from the one
below, so all classes cost little more than one.

Candidates are verified by exact containment of the item's shingles in the
whole document, on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, ship, table
from .words import U64, Words, constants, slices, text_buffer

WIDTH, HASHES, TENTHS = 5, 64, 8
#: Bytes of an index of items, about: they are searched for in one pass over the documents.
INDEX_BYTES = 48 << 20
#: What an index takes for each item (minima and places by hash function) and for each byte of its text (the byte, word places, hashes).
ITEM_BYTES, TEXT_BYTES = 12 * HASHES + 128, 8


def _tokens(words: Words, i: int) -> list[bytes]:
    a, b = words.first[i], words.first[i + 1]
    return [words.folded[s:e].tobytes() for s, e in zip(words.starts[a:b].tolist(), words.ends[a:b].tolist())]


def _exact(tokens: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    return {tuple(tokens[i : i + width]) for i in range(len(tokens) - width + 1)}


class Index:
    """The items of one block: their words, shingle hashes, and MinHash tables by class.

    Words and hashes of all items lie in a few arrays; an item's exact shingles
    are made when a candidate is verified.
    """

    def __init__(self, ids: list, texts: list[str | None], width: int = WIDTH, hashes: int = HASHES) -> None:
        words = Words(*text_buffer(pa.array(texts, pa.string())), punct=True)
        wh = words.hashes()
        self.mult = constants(hashes, 500)
        own = np.flatnonzero(words.counts)
        self.ids = [ids[i] for i in own.tolist()]
        self.widths = np.minimum(width, words.counts[own]).astype(np.int8)
        self.raw = words.folded
        self.starts, self.ends = words.starts.astype(np.uint32), words.ends.astype(np.uint32)
        self.words = np.append(words.first[:-1][own], words.first[-1]).astype(np.int64)
        parts = []
        of = words.of()
        for k in np.unique(self.widths).tolist():
            h, at = words.runs(wh, k)
            item = np.searchsorted(own, of[at])
            fits = self.widths[item] == k
            parts.append((item[fits], h[fits]))
        item, h = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64 if i == 0 else U64) for i in (0, 1))
        order = np.lexsort((h, item))
        item, h = item[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (item[1:] != item[:-1]) | (h[1:] != h[:-1])
        self.hashes, self.bounds = h[new], np.searchsorted(item[new], np.arange(len(own) + 1))
        #: {shingle width: {class: [(sorted minima, items, filter) by hash function]}}
        self.tables: dict[int, dict[int, list]] = {}
        if not len(own):
            return
        size = np.diff(self.bounds)
        classes = 1 << np.ceil(np.log2(size)).astype(np.int64)
        #: A filter of the low bits of the minima, with room for the items.
        self.mask = U64((1 << min(16, max(8, int(len(own)).bit_length() + 4))) - 1)
        groups: dict[tuple[int, int], list[int]] = {}
        for i, key in enumerate(zip(self.widths.tolist(), classes.tolist())):
            groups.setdefault(key, []).append(i)
        rows: dict[tuple[int, int], list] = {key: [] for key in groups}
        for m in self.mult:
            low = np.minimum.reduceat(self.hashes * m, self.bounds[:-1])
            for key, members in groups.items():
                mine = np.array(members, np.int32)
                order = np.argsort(low[mine], kind="stable")
                seen = np.zeros(int(self.mask) + 1, bool)
                seen[(low[mine] & self.mask).astype(np.int64)] = True
                rows[key].append((low[mine][order], mine[order], seen))
        for k, u in sorted(rows):
            self.tables.setdefault(k, {})[u] = rows[k, u]

    def exact(self, j: int) -> set[tuple[bytes, ...]]:
        """The shingles of item ``j``."""
        a, b = self.words[j], self.words[j] + self._count(j)
        tokens = [self.raw[s:e].tobytes() for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist())]
        return _exact(tokens, int(self.widths[j]))

    def _count(self, j: int) -> int:
        return int(self.words[j + 1] - self.words[j])

    def candidates(self, hashes: np.ndarray, bounds: np.ndarray, tables: dict[int, list]) -> set[tuple[int, int]]:
        """(text, item) pairs with an agreeing minimum; ``bounds`` are the texts' shingle offsets."""
        out: set[tuple[int, int]] = set()
        classes = sorted(tables)
        n = np.diff(bounds)
        texts = np.flatnonzero(n)
        if not len(texts):
            return out
        plan = []
        for c, u in enumerate(classes):
            parts = -(-n[texts] // u)
            text = np.repeat(texts, parts)
            within = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
            if c == 0:
                starts = np.repeat(bounds[:-1][texts], parts) + within * u
            else:
                ratio = u // classes[c - 1]
                starts = np.repeat(plan[-1][2], parts) + within * ratio
            plan.append((u, starts, np.cumsum(parts) - parts, text))
        for f, m in enumerate(self.mult):
            low = hashes * m
            for u, starts, _, text in plan:
                low = np.minimum.reduceat(low, starts)
                block = low.copy()
                same = text[:-1] == text[1:]
                block[:-1][same] = np.minimum(low[:-1][same], low[1:][same])
                minima, items, seen = tables[u][f]
                at = np.flatnonzero(seen[(block & self.mask).astype(np.int64)])
                if len(at):
                    v = block[at]
                    a, b = np.searchsorted(minima, v, "left"), np.searchsorted(minima, v, "right")
                    for i in np.flatnonzero(b > a).tolist():
                        for j in items[a[i] : b[i]].tolist():
                            out.add((int(text[at[i]]), j))
        return out

    def search(self, texts: pa.Array, tenths: int = TENTHS) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, shingles of the item, of them in the row) where these are tenths/10 or more."""
        for i, _, raw, off in slices(texts):
            words = Words(raw, off, punct=True)
            wh = words.hashes()
            of = words.of()
            for k, tables in self.tables.items():
                h, at = words.runs(wh, k)
                bounds = np.searchsorted(of[at], np.arange(words.texts + 1)) if len(at) else np.zeros(words.texts + 1, np.int64)
                found: dict[int, list[int]] = {}
                for d, j in self.candidates(h, bounds, tables):
                    found.setdefault(d, []).append(j)
                for d, items in sorted(found.items()):
                    own, have = h[bounds[d] : bounds[d + 1]], None
                    for j in sorted(items):
                        asked = self.hashes[self.bounds[j] : self.bounds[j + 1]]
                        if 10 * int(np.isin(asked, own).sum()) < tenths * len(asked):
                            continue
                        have = _exact(_tokens(words, d), k) if have is None else have
                        mine = self.exact(j)
                        q, shared = len(mine), len(mine & have)
                        if 10 * shared >= tenths * q:
                            yield i + d, j, q, shared


def _indexes(items: DataFrame, index_bytes: int) -> tuple[int, Iterator[Broadcast]]:
    """How many indexes the items take, and these, broadcast one by one."""
    spark = items.sparkSession
    ship(spark)
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = asked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) * TEXT_BYTES + ITEM_BYTES)).first()[0] or 0
    blocks = max(1, -(-total // index_bytes))

    def built() -> Iterator[Broadcast]:
        for b in range(blocks):
            block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
            got = block.collect()
            yield spark.sparkContext.broadcast(Index([r.item_id for r in got], [r.text for r in got]))

    return blocks, built()


def without_items(docs: DataFrame, items: DataFrame, tenths: int = TENTHS, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text contains no item (see ``find_items``).

    With several blocks of items, the rows are written after each, so that one
    index at a time is in memory. Null texts, repeated rows and extra columns of
    any name stay; an empty table stays empty.
    """
    at = docs.columns.index("text")
    blocks, indexes = _indexes(items, index_bytes)
    space = Workspace(docs.sparkSession, "clean") if blocks > 1 else None
    for b, index in enumerate(indexes):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, *_ in index.value.search(batch.column(at), tenths)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
        if space:
            docs = space.put(docs, f"after-{b}")
            index.destroy()
            if b:
                space.drop(f"after-{b - 1}")
    return docs


def find_items(docs: DataFrame, items: DataFrame, tenths: int = TENTHS, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Documents that contain a test item: doc_id, item_id, n_item, n_shared.

    Words are runs of ASCII letters, digits and non-ASCII characters with A-Z
    lower-cased; an item's shingles are its distinct runs of five words (of all
    its words, if fewer). A row says that ``n_shared`` of the item's ``n_item``
    shingles, at least tenths/10 of them, are in the document.

    The items are the query set: they are searched for in blocks whose index
    takes about ``index_bytes``, one pass over the documents each, so what is
    broadcast is bounded however many there are. Items and texts without words
    match nothing; null ids stay null; repeated rows give rows of their own.
    Extra columns are ignored; empty tables give an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks, indexes = _indexes(items, index_bytes)
    space = Workspace(docs.sparkSession, "found") if blocks > 1 else None
    out = None
    for b, index in enumerate(indexes):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                found = list(index.value.search(batch.column(1), tenths))
                cols = list(zip(*found)) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(cols[0], pa.int64())), pa.array([index.value.ids[j] for j in cols[1]], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                    ["doc_id", "item_id", "n_item", "n_shared"],
                )

        part = rows.mapInArrow(run, "doc_id long, item_id long, n_item long, n_shared long")
        if space:
            part = space.put(part, f"items-{b}")
            index.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def op2_containment(spark, sf_dir):
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH i AS (SELECT item_id, w, least(5, len(w)) AS k FROM (SELECT item_id, regexp_extract_all(lower(text), '(?:[0-9a-z]|[^\x00-\x7F])+') AS w FROM benchmark) WHERE len(w) > 0),
s AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM i)),
q AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY item_id),
d AS (SELECT doc_id, w, k FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[0-9a-z]|[^\x00-\x7F])+') AS w FROM documents), (SELECT DISTINCT k FROM i)),
t AS (SELECT DISTINCT doc_id, k, array_to_string(w[p : p + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM d))
SELECT doc_id, item_id, n_item, count(*) AS n_shared FROM t JOIN s USING (k, g) JOIN q USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING 10 * count(*) >= 8 * n_item
""".replace("lower(text)", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
