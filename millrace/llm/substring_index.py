"""Substring dedup by a log-structured index of window fingerprints.

A window is 13 consecutive words. Its fingerprint is the smallest hash of the
nine five-word runs in it, so equal windows have equal fingerprints, and
neighbouring windows mostly share theirs: the index holds about a fifth as many
rows as there are windows.

The index is a folder of immutable runs, tables bucketed and sorted by their
key, of three kinds: ``grams`` (fingerprint, first and last document that holds
it), ``windows`` (128-bit hash of a whole window whose fingerprint several
documents hold, first and last document) and ``texts`` (digest of a text, first
document). A new batch becomes a run of each kind. It is merge-joined with the
older runs, bucket by bucket and without a shuffle. Two runs of a level are
compacted into one of the next, again by a merge join, so a row is rewritten
once a level. A manifest names the runs; a later session opens the index by it
and adds batches without reading the earlier documents, but those that turn out
to be a fingerprint's only holder so far.

Shared fingerprints only nominate. Their windows are hashed in full by two
families, 64 bits each and both compared, and the smallest document of each
whole window decides what is removed. A text that an earlier document has is
found by its digest and isn't indexed, as all its windows are that one's.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, pick, release, ship, shuffle_parts, table
from .words import U64, Words, constants, mix64, slices

WINDOW, GRAM = 13, 5
BATCHES = 2
#: Runs of a level that become one of the next.
FANOUT = 2
NO_ID = -(1 << 63)


def _rolled(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, also across texts."""
    m = len(hashes) - width + 1
    c = constants(width, 300 + seed)
    h = hashes[:m] * c[0]
    for j in range(1, width):
        h += hashes[j : j + m] * c[j]
    return mix64(h)


def windows(words: Words, window: int = WINDOW, gram: int = GRAM, full: bool = False) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray] | None]:
    """(first word, fingerprint, full hashes by two families if asked for) of every window inside a text."""
    m = words.n - window + 1
    none = np.empty(0, U64)
    if m <= 0:
        return np.empty(0, np.int64), none, (none, none) if full else None
    of = words.of()
    at = np.flatnonzero(of[:m] == of[window - 1 :])
    one = words.hashes(0)
    low = _rolled(one, gram, 0)
    span, wide = 1, window - gram + 1
    while 2 * span <= wide:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < wide:
        low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
    return at, low[at], (_rolled(words.hashes(1), window, 1)[at], _rolled(one, window, 2)[at]) if full else None


def _fingerprints(window: int, gram: int):
    """d, text -> the distinct (fp, d) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for i, j, raw, off in slices(b.column(1)):
                words = Words(raw, off, lower=False)
                at, fp, _ = windows(words, window, gram)
                of = words.of()[at] if len(at) else at
                order = np.lexsort((fp, of))
                fp, of = fp[order], of[order]
                new = np.ones(len(fp), bool)
                new[1:] = (fp[1:] != fp[:-1]) | (of[1:] != of[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(fp[new].view(np.int64)), pa.array(ids[i:j][of[new]])], ["fp", "d"])

    return run


def _windows_of(window: int, gram: int):
    """d, text, fps -> (w, v, d) of the distinct windows whose fingerprint is listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, listed = b.column(0).to_numpy(), b.column(2)
            for i, j, raw, off in slices(b.column(1)):
                words = Words(raw, off, lower=False)
                at, fp, (w, v) = windows(words, window, gram, True)
                bounds = np.searchsorted(words.of()[at] if len(at) else at, np.arange(j - i + 1))
                parts, docs = [], []
                for d in range(j - i):
                    x, y = bounds[d], bounds[d + 1]
                    wanted = x + np.flatnonzero(np.isin(fp[x:y], listed[i + d].values.to_numpy().view(U64)))
                    own = wanted[np.lexsort((v[wanted], w[wanted]))]
                    new = np.ones(len(own), bool)
                    new[1:] = (w[own[1:]] != w[own[:-1]]) | (v[own[1:]] != v[own[:-1]])
                    parts.append(own[new])
                    docs.append(np.full(int(new.sum()), ids[i + d], np.int64))
                if parts:
                    own = np.concatenate(parts)
                    yield pa.RecordBatch.from_arrays([pa.array(w[own].view(np.int64)), pa.array(v[own].view(np.int64)), pa.array(np.concatenate(docs))], ["w", "v", "d"])

    return run


def _cleaned(window: int, gram: int):
    """d, text, gone (windows by one family, or null) -> the document's result row.

    Both families were compared between documents; inside one document 64 bits tell its windows apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = b.column(2)
            for i, j, raw, off in slices(b.column(1)):
                words = Words(raw, off, lower=False)
                drop = np.zeros(words.n + 1, np.int64)
                if gone.null_count < len(gone):
                    at, _, (w, _) = windows(words, window, gram, True)
                    bounds = np.searchsorted(words.of()[at] if len(at) else at, np.arange(j - i + 1))
                    for d in range(j - i):
                        listed = gone[i + d].as_py()
                        if listed:
                            x, y = bounds[d], bounds[d + 1]
                            hit = at[x:y][np.isin(w[x:y], np.array(listed, np.int64).view(U64))]
                            np.add.at(drop, hit, 1)
                            np.add.at(drop, hit + window, -1)
                lost = np.cumsum(drop)[:-1] > 0
                data, n, removed, sha = raw.tobytes(), [], [], []
                starts, ends = words.starts.tolist(), words.ends.tolist()
                for d in range(words.texts):
                    x, y = int(words.first[d]), int(words.first[d + 1])
                    own = lost[x:y]
                    keep = (np.flatnonzero(~own) + x).tolist() if own.any() else range(x, y)
                    n.append(y - x)
                    removed.append(int(own.sum()))
                    sha.append(hashlib.sha256(b" ".join([data[starts[k] : ends[k]] for k in keep])).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)], ["d", "n_words", "n_removed", "kept_sha256"])

    return run


#: Of each kind of run: its key and its columns.
KINDS = {"grams": (["fp"], "fp long, lo long, hi long"), "windows": (["w", "v"], "w long, v long, lo long, hi long"), "texts": (["sum"], "sum string, lo long, hi long")}


class SubstringIndex:
    """Runs in a folder that grow batch by batch, in one session or in many.

    A folder with a manifest is opened as it is (its ``window``, ``gram`` and
    buckets hold); else an empty index begins. The runs are tables of the
    session's catalog only between opening and ``close``. One writer at a time:
    a manifest that another has written meanwhile raises RuntimeError.
    """

    def __init__(self, spark: SparkSession, path: str, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT) -> None:
        ship(spark)
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        self.window, self.gram, self.buckets = window, gram, shuffle_parts(spark)
        #: The largest document indexed, the manifest's number, and how many rows compaction has written so far.
        self.last: int | None = None
        self.version, self.rewritten = 0, 0
        self.runs: list[dict] = []
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(self.path))
        self._open()

    def __enter__(self) -> SubstringIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _open(self) -> None:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at(self.path))]
        known = sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))
        if not known:
            return
        text = self.spark.read.text(f"{self.path}/manifest-{known[-1]:08d}.json", wholetext=True).first()[0]
        state = json.loads(text)
        self.version = known[-1]
        self.window, self.gram, self.buckets, self.last, self.rewritten, self.runs = (state[k] for k in ("window", "gram", "buckets", "last", "rewritten", "runs"))
        for r in self.runs:
            key = ", ".join(KINDS[r["kind"]][0])
            self.spark.sql(f"CREATE TABLE {r['name']} ({KINDS[r['kind']][1].replace('long', 'bigint')}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{r['name']}'")

    def _save(self, gone: list[dict]) -> None:
        """The next manifest, by a rename; then the runs that it doesn't name go."""
        state = {k: getattr(self, k) for k in ("window", "gram", "buckets", "last", "rewritten", "runs")}
        draft, final = self._at(f"{self.path}/draft-{uuid.uuid4().hex}"), self._at(f"{self.path}/manifest-{self.version + 1:08d}.json")
        out = self._fs.create(draft)
        out.writeBytes(json.dumps(state))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"another session has written {final.getName()}")
        self._fs.delete(self._at(f"{self.path}/manifest-{self.version:08d}.json"), False)
        self.version += 1
        for r in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {r['name']}")
            self._fs.delete(self._at(f"{self.path}/{r['name']}"), True)

    def close(self) -> None:
        """Take the runs out of the session's catalog; their files stay."""
        for r in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {r['name']}")

    def _write(self, kind: str, rows: DataFrame, level: int = 0) -> dict:
        """``rows`` as a run: a bucketed, sorted table in the index's folder."""
        name, key = f"millrace_run_{uuid.uuid4().hex}", KINDS[kind][0]
        rows.write.bucketBy(self.buckets, *key).sortBy(*key).option("path", f"{self.path}/{name}").option("compression", "zstd").saveAsTable(name)
        return {"kind": kind, "name": name, "level": level}

    def _of(self, kind: str) -> list[dict]:
        return [r for r in self.runs if r["kind"] == kind]

    def _against(self, run: dict) -> DataFrame:
        """The rows of a new run with the first and last document (``olo``, ``ohi``) of the older runs."""
        kind, key = run["kind"], KINDS[run["kind"]][0]
        both = self.spark.table(run["name"])
        lows, highs = [], []
        for i, old in enumerate(self._of(kind)):
            both = both.join(self.spark.table(old["name"]).select(*key, F.col("lo").alias(f"lo{i}"), F.col("hi").alias(f"hi{i}")), key, "left")
            lows.append(F.col(f"lo{i}")), highs.append(F.col(f"hi{i}"))
        none = F.lit(None).cast("long")
        least = F.least(*lows) if len(lows) > 1 else lows[0] if lows else none
        most = F.greatest(*highs) if len(highs) > 1 else highs[0] if highs else none
        return both.select(*key, "lo", "hi", least.alias("olo"), most.alias("ohi"))

    def add(self, batch: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """Index ``batch(d, text)`` and return its result rows (RESULT).

        The batch's documents must be larger than all indexed ones, else
        ValueError is raised; earlier ones are not judged again. ``history(d,
        text)`` gives the indexed documents; of it only those are read that were
        the one holder of a fingerprint which the batch has too.
        """
        ends = batch.agg(F.min("d").alias("lo"), F.max("d").alias("hi")).first()
        if self.last is not None and ends.lo is not None and ends.lo <= self.last:
            raise ValueError(f"document {ends.lo} is not larger than {self.last}, which is indexed")
        space = Workspace(self.spark, "substrings")
        batch = batch.select("d", F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("sum"), "text")
        fresh: list[dict] = []

        # Texts that an earlier document has.
        sums = batch.select("d", "sum")
        held_by = self._write("texts", sums.groupBy("sum").agg(F.min("d").alias("lo"), F.max("d").alias("hi")))
        fresh.append(held_by)
        first = self._against(held_by).select("sum", F.least("lo", "olo").alias("first"), "hi").where("first < hi").select("sum", "first")
        # Written and joined by broadcast or a plain shuffle: beside a bucketed side a large group of copies couldn't be split.
        copies = space.put(pick(sums, space.put(first, "first"), ["sum"]).where("first < d").select("d", "sum").distinct(), "copies")
        own = pick(batch, copies, ["d", "sum"], "left_anti").select("d", "text")

        # Fingerprints, and which of them several documents hold.
        held = own.mapInArrow(_fingerprints(self.window, self.gram), "fp long, d long")
        grams = self._write("grams", held.groupBy("fp").agg(F.min("d").alias("lo"), F.max("d").alias("hi")))
        fresh.append(grams)
        shared = space.put(self._against(grams).where("lo < hi OR olo IS NOT NULL").select("fp", F.when(F.col("olo") == F.col("ohi"), F.col("olo")).alias("alone")), "shared")
        found = held.join(shared.select("fp"), "fp").select("fp", "d").unionByName(shared.where("alone IS NOT NULL").select("fp", F.col("alone").alias("d")))
        # One document's own fingerprints, so a list is bounded by the document.
        lists = space.put(found.groupBy("d").agg(F.collect_set("fp").alias("fps")), "lists")
        del found
        release(self.spark)

        # Their windows in full, and which of these a smaller document has.
        texts = own if history is None or self.last is None else own.unionByName(history.select("d", "text").where(F.col("d") <= self.last))
        read = pick(texts, lists.select("d"), ["d"], "left_semi").join(lists, "d").select("d", "text", "fps")
        whole = space.put(read.mapInArrow(_windows_of(self.window, self.gram), "w long, v long, d long"), "windows")
        space.drop("lists")
        windows_run = self._write("windows", whole.groupBy("w", "v").agg(F.min("d").alias("lo"), F.max("d").alias("hi")))
        fresh.append(windows_run)
        first = self._against(windows_run).select("w", "v", F.least("lo", "olo").alias("first"), "hi").where("first < hi").select("w", "v", "first")
        new = F.lit(True) if self.last is None else F.col("d") > self.last
        lost = whole.where(new).join(first, ["w", "v"]).where("first < d")
        gone = space.put(lost.groupBy("d").agg(F.collect_set("w").alias("gone")), "gone")
        space.drop("windows")
        space.drop("shared")

        self.runs += fresh
        self.last = ends.hi if ends.hi is not None else self.last
        self._save(self._compact())
        release(self.spark)

        clean, none = _cleaned(self.window, self.gram), F.lit(None).cast("array<bigint>")
        kept = pick(own, gone.select("d"), ["d"], "left_anti").select("d", "text", none.alias("gone")).mapInArrow(clean, RESULT)
        cut = pick(own, gone.select("d"), ["d"], "left_semi").join(gone, "d").select("d", "text", "gone").mapInArrow(clean, RESULT)
        copy = pick(batch, copies, ["d", "sum"], "left_semi").select("d", "text").mapInArrow(_copied(self.window), RESULT)
        return kept.unionByName(cut).unionByName(copy)

    def _compact(self) -> list[dict]:
        """Merge runs of one level while there are ``fanout`` of them; returns those that are no longer needed."""
        gone: list[dict] = []
        for kind, (key, _) in KINDS.items():
            level = 0
            while any(r["level"] >= level for r in self._of(kind)):
                same = [r for r in self._of(kind) if r["level"] == level]
                while len(same) >= self.fanout:
                    part, same = same[: self.fanout], same[self.fanout :]
                    whole = part[0]
                    for other in part[1:]:
                        more = self.spark.table(other["name"]).select(*key, F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
                        merged = self.spark.table(whole["name"]).join(more, key, "full")
                        gone.append(whole)
                        whole = self._write(kind, merged.select(*key, F.least("lo", "lo2").alias("lo"), F.greatest("hi", "hi2").alias("hi")), level + 1)
                        gone.append(other)
                        self.rewritten += self.spark.table(whole["name"]).count()
                    self.runs = [r for r in self.runs if r not in part] + [whole]
                level += 1
        return gone


def _copied(window: int):
    """d, text of texts that an earlier document has too -> their result rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, raw, off in slices(b.column(1)):
                words = Words(raw, off, lower=False)
                data, starts, ends = raw.tobytes(), words.starts, words.ends
                removed = np.where(words.counts >= window, words.counts, 0)
                sha = []
                for d in range(words.texts):
                    span = range(0) if removed[d] else range(words.first[d], words.first[d + 1])
                    sha.append(hashlib.sha256(b" ".join([data[starts[k] : ends[k]] for k in span])).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(words.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(sha)], ["d", "n_words", "n_removed", "kept_sha256"])

    return run


RESULT = "d long, n_words long, n_removed long, kept_sha256 string"


def dedup(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT) -> DataFrame:
    """Every document without the words that an earlier document's windows cover.

    A word goes if a window of ``window`` words over it also starts in a document
    with a smaller doc_id; windows are those of the input. Documents enter a new
    index in ``batches`` ranges of doc_id, as if they had come one after another.

    Returns doc_id, n_words, n_removed and kept_sha256 (of the kept words joined
    by a space). A null text has no words; a null doc_id is smaller than any
    other. Rows that repeat a doc_id are one document, so they don't remove from
    each other. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.col("text").cast("string").alias("text"))
    cuts: list = []
    if batches > 1:
        cuts = rows.agg(F.percentile_approx("d", [i / batches for i in range(1, batches)], 10_000).alias("cuts")).first().cuts or []
    cuts = sorted(set(cuts))
    out = None
    with SubstringIndex(spark, f"{Workspace(spark, 'substring-index').path}/runs", window, gram, fanout) as index:
        for low, high in zip([None, *cuts], [*cuts, None]):
            part = rows if low is None else rows.where(F.col("d") > low)
            more = index.add(part if high is None else part.where(F.col("d") <= high), rows)
            out = more if out is None else out.unionByName(more)
    return out.select(F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op6_substring_index(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, w FROM d WHERE len(w) >= 13),
h AS (SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS g FROM x),
f AS (SELECT g, min(doc_id) AS lo FROM h GROUP BY g HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM h JOIN f USING (g) WHERE lo < doc_id),
k AS (SELECT doc_id, list(p) AS gone FROM r GROUP BY doc_id),
o AS (SELECT d.doc_id, w, coalesce(gone, []::BIGINT[]) AS gone FROM d LEFT JOIN k ON d.doc_id = k.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
       sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]), ' ')) AS kept_sha256
FROM o
"""
