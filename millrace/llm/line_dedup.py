"""Line dedup by range-partitioned hashes, giving keep bitmaps.

Keys of long lines become 128-bit hashes with their document and place. They
are range-partitioned by (hash, document), so a line that a third of the
documents holds is dealt to many tasks, and sorted by hash, document downwards
and place. One pass streams each sorted run and sees a key's largest document
first; the lines of the others are dropped once enough documents hold the key.
Only the first and last key of a run may go on in a neighbour: the first key's
rows, and the last one's while too few documents hold it, wait for the sum of
the (at most two a run) counts of such keys.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, ship, shuffle_parts, table

LEAST_POINTS, LEAST_DOCS = 40, 5
_BLANK = b" \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)


def line_key(line: bytes) -> bytes:
    return line.strip(_BLANK).lower()


def _points(key: bytes) -> int:
    return len(key.decode("utf-8", "replace"))


def _lines(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, th = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = [[], [], [], [], []]
            for i, t in enumerate(batch.column(2)):
                lines = (t.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")
                out[0].append(d[i]), out[1].append(th[i]), out[2].append(-len(lines)), out[3].append(0), out[4].append(0)
                for j, line in enumerate(lines):
                    if len(line) < least:
                        continue
                    key = line.strip(_BLANK)
                    if len(key) < least or len(key) < 4 * least and _points(key) < least:
                        continue
                    h = xxhash.xxh3_128_digest(key.lower())
                    out[0].append(d[i]), out[1].append(th[i]), out[2].append(j)
                    out[3].append(int.from_bytes(h[:8], "little", signed=True)), out[4].append(int.from_bytes(h[8:], "little", signed=True))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["d", "th", "place", "h1", "h2"])

    return run


class _Open:
    """A run's key that may go on: how many documents hold it so far, and the rows that wait for more."""

    def __init__(self, key: tuple[int, int], top: int, first: bool) -> None:
        self.key, self.top, self.last, self.first, self.docs = key, top, top, first, 0
        self.waiting: list[list[np.ndarray]] = []

    def end(self) -> list[np.ndarray]:
        return [np.array([x], np.int64) for x in (*self.key, self.top, 0, 0)]


def _drops(least_docs: int):
    """Rows of one sorted run -> dropped rows (kind 0), waiting rows (1), open keys (2).

    Batches stream through: between them only the open key is held, with the
    rows of fewer than ``least_docs`` documents. The largest document of a key
    comes first, so once enough hold the key its other rows go at once.
    """

    def rows(kind: int, part: list[np.ndarray], docs: int = 0) -> pa.RecordBatch:
        n = len(part[0])
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *[pa.array(x) for x in part], pa.array(np.full(n, docs, np.int64))], ["kind", "h1", "h2", "d", "th", "place", "docs"])

    def grow(key: _Open, part: list[np.ndarray], docs: int) -> Iterator[pa.RecordBatch]:
        """The next rows of the open key, ``docs`` of whose documents are new."""
        key.docs += docs
        key.last = int(part[2][-1])
        if key.first:
            yield rows(1, part)
            return
        rest = [x[part[2] != key.top] for x in part]
        key.waiting.append(rest)
        if key.docs >= least_docs:
            for held in key.waiting:
                if len(held[0]):
                    yield rows(0, held)
            key.waiting = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: _Open | None = None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            cols = [b.column(i).to_numpy() for i in range(5)]
            h1, h2, d = cols[:3]
            new, other = np.ones(n, bool), np.ones(n, bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            other[1:] = new[1:] | (d[1:] != d[:-1])
            if key and key.key == (int(h1[0]), int(h2[0])):
                new[0], other[0] = False, key.last != d[0]
            first = np.flatnonzero(new)
            head = int(first[0]) if len(first) else n
            if head:  # goes on from the batch before
                yield from grow(key, [c[:head] for c in cols], int(other[:head].sum()))
            if not len(first):
                continue
            if key and key.first:
                yield rows(2, key.end(), key.docs)
            start = 0
            if key is None:  # the run's first key may have begun in the run before
                key, start = _Open((int(h1[0]), int(h2[0])), int(d[0]), True), 1
                end = int(first[1]) if len(first) > 1 else n
                yield from grow(key, [c[:end] for c in cols], int(other[:end].sum()))
                if len(first) == 1:
                    continue
                yield rows(2, key.end(), key.docs)
            if start < len(first) - 1:  # keys that begin and end here
                a, z = int(first[start]), int(first[-1])
                bounds = first[start:-1] - a
                docs = np.add.reduceat(other[a:z].astype(np.int64), bounds)
                size = np.diff(np.append(bounds, z - a))
                gone = np.flatnonzero(np.repeat(docs >= least_docs, size) & (d[a:z] != np.repeat(d[a + bounds], size))) + a
                if len(gone):
                    yield rows(0, [c[gone] for c in cols])
            a = int(first[-1])
            key = _Open((int(h1[a]), int(h2[a])), int(d[a]), False)
            yield from grow(key, [c[a:] for c in cols], int(other[a:].sum()))
        if key:  # may go on in the next run
            for held in key.waiting:
                yield rows(1, held)
            yield rows(2, key.end(), key.docs)

    return run


def _bitmap(places: np.ndarray, n: int) -> bytes:
    keep = np.ones(n, np.uint8)
    keep[places] = 0
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6)


def kept_lines(bitmap: bytes | None, n: int) -> np.ndarray:
    """A keep bitmap as booleans; no bitmap keeps all."""
    if bitmap is None:
        return np.ones(n, bool)
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n, bitorder="little").astype(bool)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        places, n = b.column(3), b.column(2).to_pylist()
        maps = [None if p.as_py() is None else _bitmap(np.array(p.as_py(), np.int64), k) for p, k in zip(places, n)]
        lost = [0 if p.as_py() is None else len(p) for p in places]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(lost, pa.int64()), pa.array(maps, pa.binary())], ["d", "th", "n_lines", "n_dropped", "keep"])


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("th"), text.alias("text"))


def line_bitmaps(docs: DataFrame, least_points: int = LEAST_POINTS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Keep bitmaps of the lines of every document, without its text.

    Lines are split at a line feed; a null or empty text is one empty line. A
    line's key is the line stripped of blanks at both ends with A-Z lower-cased.
    Keys of ``least_points`` code points found in ``least_docs`` documents lose
    all their lines but those of the largest doc_id that holds them.

    Returns d (doc_id; a null one as the least long), th (hash of the text),
    n_lines, n_dropped and keep: the compressed bitmap, null if all stay. Rows
    that repeat a doc_id are one document for counting, and rows that repeat a
    text too have one result row. Extra columns are ignored; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    space = Workspace(spark, "lines")
    lines = space.put(_keyed(docs).mapInArrow(_lines(least_points), "d long, th long, place long, h1 long, h2 long"), "lines")
    keys = lines.where("place >= 0").select("h1", "h2", "d", "th", "place")
    order = [F.col("h1"), F.col("h2"), F.col("d").desc()]
    run = keys.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order, "th", "place")
    found = space.put(run.mapInArrow(_drops(least_docs), "kind int, h1 long, h2 long, d long, th long, place long, docs long"), "found")
    # At most two rows for each run: its size is bounded by the number of partitions.
    open_keys = F.broadcast(found.where("kind = 2").groupBy("h1", "h2").agg(F.sum("docs").alias("held"), F.max("d").alias("top")))
    late = found.where("kind = 1").select("h1", "h2", "d", "th", "place").join(open_keys, ["h1", "h2"]).where((F.col("held") >= least_docs) & (F.col("d") != F.col("top")))
    drops = found.where("kind = 0").select("d", "th", "place").unionByName(late.select("d", "th", "place"))
    # One document's lines, so a list is bounded by the document; rows repeated in the input repeat here.
    lost = drops.groupBy("d", "th").agg(F.collect_set("place").alias("places"))
    heads = lines.where("place < 0").select("d", "th", (-F.col("place")).alias("n_lines")).distinct()
    return heads.join(lost, ["d", "th"], "left").select("d", "th", "n_lines", "places").mapInArrow(_bitmaps, "d long, th long, n_lines long, n_dropped long, keep binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sha, count = [], []
        for t, keep in zip(b.column(2), b.column(3)):
            data = (t.as_py() or "").encode("utf-8", "surrogatepass")
            m = keep.as_py()
            lines = data.split(b"\n")
            count.append(len(lines))
            if m is not None:
                k = kept_lines(m, len(lines))
                data = b"\n".join([x for x, y in zip(lines, k.tolist()) if y])
            sha.append(hashlib.sha256(data).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), b.column(1), pa.array(sha)], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def op7_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    maps = line_bitmaps(docs).where("n_dropped > 0").select("d", "th", "n_dropped", "keep")
    joined = _keyed(docs).join(maps, ["d", "th"], "left").select(F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), "text", "keep")
    return joined.mapInArrow(_apply, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


ORACLE = r"""
WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS place, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
x AS (SELECT k.doc_id, place, line, coalesce(k.doc_id <> g.top, false) AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM x GROUP BY doc_id
"""
