"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A document's set of five-word shingles gets a signature of ``HASHES`` MinHash
values of 16 bits. Sets with Jaccard similarity s differ in about HASHES*(1-s)
of them, so pairs at 0.85 lie within ``DISTANCE`` but for a chance of 5e-6.
Signatures are split into chunks so that, by the pigeonhole principle, two
signatures within DISTANCE agree in some chunk up to ``ERRORS`` values. The
allowed errors are enumerated: one key for each chunk with one value left out.
Two signatures within the distance share a key for certain.

Documents with equal sets are one class from the start. A key's classes are
joined as a star to its smallest, never pair by pair, and the components of
these stars (families) hold all pairs within the distance. Within a family the
pairs are confirmed on full shingle sets; a task looks only at pairs that share
one of their rarest shingles (which every pair over the threshold does) and
aren't connected yet.

A family too large for a task is first thinned around a central document, the
pivot, in time linear in its size: documents linked to the pivot are connected
at once. A document that has less than the threshold's share of its shingles in
common with the pivot can only be linked to one with which it shares a shingle
that the pivot lacks, so the family falls apart into groups by such shingles,
each with an unconnected document. After ``ROUNDS`` rounds a family still too
large is dealt to tasks in blocks, every pair of blocks meeting once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, pick, read_few, release, ship, table
from .graph import PAIR, components
from .words import U64, Words, constants, mix64, shingle_sets, slices, trim_memory

HASHES, DISTANCE, ERRORS = 64, 23, 1
#: Shingles of a block of a family; a task holds two blocks.
BLOCK_SHINGLES = 1_000_000
#: Rounds of thinning, and documents among which a pivot is sought.
ROUNDS, PIVOT_SAMPLE = 4, 48
NO_ID = -(1 << 63)


def chunks(distance: int = DISTANCE, errors: int = ERRORS, hashes: int = HASHES) -> list[np.ndarray]:
    """Chunks such that signatures within ``distance`` agree in one up to ``errors`` values."""
    return np.array_split(np.arange(hashes), -(-(distance + 1) // (errors + 1)))


def signatures(h: np.ndarray, bounds: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """16-bit MinHash values, (sets, hashes), of nonempty sets of shingle hashes."""
    out = np.empty((len(bounds) - 1, hashes), np.uint16)
    for i, m in enumerate(constants(hashes, 600)):
        x = h * m
        x ^= x >> U64(32)
        x *= U64(0x94D049BB133111EB)
        out[:, i] = (np.minimum.reduceat(x, bounds[:-1]) >> U64(20)).astype(np.uint16)
    return out


def keys_of(signs: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Keys (documents, keys): each chunk with each of its values left out."""
    out = []
    for c, part in enumerate(chunks(distance, ERRORS, signs.shape[1])):
        wide = signs[:, part].astype(U64) + U64(1)
        mult = constants(len(part), 700 + c)
        terms = mix64(wide * mult)
        whole = terms.sum(1, dtype=U64)
        for o in range(len(part)):
            out.append(mix64(whole - terms[:, o] + U64(1000 * c + o)))
    return np.stack(out, 1)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, raw, off in slices(b.column(2)):
            h, o = shingle_sets(Words(raw, off))
            n = np.diff(o)
            full = np.flatnonzero(n)
            k1, k2, sig = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64), [None] * (j - i)
            if len(full):
                at = np.append(o[:-1][full], len(h))
                k1[full] = np.add.reduceat(mix64(h), at[:-1]).view(np.int64)
                k2[full] = np.add.reduceat(mix64(h * U64(0x9E3779B97F4A7C15) + U64(1)), at[:-1]).view(np.int64)
                for d, s in zip(full.tolist(), signatures(h, at)):
                    sig[d] = s.tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(k1), pa.array(k2), pa.array(sig, pa.binary())], ["d", "th", "n", "k1", "k2", "sig"]
            )
    trim_memory()


def _keys(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                signs = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(b.num_rows, -1)
                k = keys_of(signs, distance)
                yield pa.RecordBatch.from_arrays([pa.array(k.reshape(-1).view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), k.shape[1]))], ["key", "d"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """d, family, blocks, text -> the whole shingle set of each."""
    for b in batches:
        for i, j, raw, off in slices(b.column(3)):
            h, o = shingle_sets(Words(raw, off))
            data = pa.array([h[x:y].tobytes() for x, y in zip(o[:-1], o[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in range(3)), data], ["d", "family", "blocks", "set"])
    trim_memory()


def confirm(ids: np.ndarray, block: np.ndarray, sets: list[np.ndarray], percent: int, across: bool, roots: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links among some documents, enough to connect all that are linked.

    Documents of one of ``roots`` are connected already. Confirms 100 * intersection >= percent * union on full sets for every pair
    (of different blocks, if ``across``) that isn't connected by earlier links.
    Pairs over the threshold share a shingle among the n - ceil(n*percent/100) + 1
    rarest of each, by any common order; only those pairs are counted.
    """
    n = np.array([len(s) for s in sets])
    order = np.lexsort((ids, n))
    ids, block, sets, n = ids[order], block[order], [sets[i] for i in order], n[order]
    root = np.arange(len(ids)) if roots is None else np.unique(roots[order], return_inverse=True)[1]
    if len(ids) < 2:
        return []
    values, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    token, df = token.astype(np.int32), df.astype(np.int32)
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), n)
    rare = np.lexsort((token, df[token], doc))
    token, first = token[rare], np.concatenate([[0], np.cumsum(n)])
    prefix = n - -(-percent * n // 100) + 1
    rank = np.arange(len(token)) - np.repeat(first[:-1], n)
    common = df[token] > 1
    shared, shared_first = token[common], np.concatenate([[0], np.cumsum(np.add.reduceat(common, first[:-1]))])
    listed = np.flatnonzero(common & (rank < np.repeat(prefix, n)))
    # Inverted lists: documents by prefix token, ascending; and each entry's place in its list.
    by = np.argsort(token[listed], kind="stable")
    entry_token, entry_doc = token[listed][by], doc[listed][by]
    list_first = np.searchsorted(entry_token, np.arange(len(values) + 1))
    place = np.empty(len(listed), np.int64)
    place[by] = np.arange(len(listed))
    own_first = np.searchsorted(doc[listed], np.arange(len(ids) + 1))
    mark = np.zeros(len(values), np.uint8)
    out = []
    for x in range(len(ids)):
        spans = [entry_doc[list_first[token[listed[e]]] : place[e]] for e in range(own_first[x], own_first[x + 1])]
        if not spans:
            continue
        y = np.unique(np.concatenate(spans))
        y = y[(root[y] != root[x]) & (100 * n[y] >= percent * n[x])]
        if across:
            y = y[block[y] != block[x]]
        if not len(y):
            continue
        mine = shared[shared_first[x] : shared_first[x + 1]]
        mark[mine] = 1
        for at in range(0, len(y), 256):
            part = y[at : at + 256]
            part = part[root[part] != root[x]]
            if not len(part):
                continue
            size = shared_first[part + 1] - shared_first[part]
            where = np.concatenate([np.arange(shared_first[p], shared_first[p + 1]) for p in part])
            sums = np.concatenate([[0], np.cumsum(mark[shared[where]], dtype=np.int64)])
            ends = np.cumsum(size)
            both = sums[ends] - sums[ends - size]
            for p in part[100 * both >= percent * (n[part] + n[x] - both)].tolist():
                if root[p] != root[x]:
                    out.append((int(ids[p]), int(ids[x])))
                    a, b = min(root[p], root[x]), max(root[p], root[x])
                    root[root == b] = a
        mark[mine] = 0
    return out


def _unit(percent: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        x, y = t["x"][0].as_py(), t["y"][0].as_py()
        sets = [np.frombuffer(s.as_py(), U64) for s in t["set"]]
        links = confirm(t["d"].to_numpy(), t["block"].to_numpy(), sets, percent, x != y, t["root"].to_numpy())
        if len(sets) > 500:
            trim_memory()
        return pa.table([pa.array([p[i] for p in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


# --- thinning of large families ---------------------------------------------------


def _pivot(t: pa.Table) -> pa.Table:
    """Of some documents of a family, the one with the most shingles in common with the others."""
    t = t.combine_chunks()
    sets = [np.frombuffer(s.as_py(), U64) for s in t["set"]]
    values, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    # Shared shingles, less those that the document has beyond them: neither the shortest nor the longest wins.
    score = [float((df[token[a:b]] - 1).sum()) / (len(sets) + b - a) for a, b in zip(first[:-1], first[1:])]
    best = max(range(len(sets)), key=lambda i: (score[i], -t["d"][i].as_py()))
    return pa.table([t["family"].slice(best, 1), t["d"].slice(best, 1), t["set"].slice(best, 1)], ["family", "p", "pivot"])


def _against_pivot(percent: int):
    """d, family, root, set, p, pivot -> linked, free (only shingles beyond the pivot's can link it), n, beyond."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked, free, n, beyond = [], [], [], []
            for own, pivot in zip(b.column(3), b.column(5)):
                x, q = np.frombuffer(own.as_py(), U64), np.frombuffer(pivot.as_py(), U64)
                common = np.isin(x, q, assume_unique=True)
                both = int(common.sum())
                linked.append(100 * both >= percent * (len(x) + len(q) - both))
                free.append(100 * both < percent * len(x))
                n.append(len(x))
                beyond.append(x[~common].tobytes())
            kinds = [pa.bool_(), pa.bool_(), pa.int64(), pa.binary()]
            more = [pa.array(v, k) for v, k in zip((linked, free, n, beyond), kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *more], ["d", "family", "root", "set", "p", "linked", "free", "n", "beyond"])

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [np.frombuffer(s.as_py(), np.int64) for s in b.column(3)]
        many = [len(s) for s in sets]
        if sum(many):
            spread = [pa.array(np.repeat(b.column(i).to_numpy(zero_copy_only=False), many)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*spread, pa.array(np.concatenate(sets))], ["d", "family", "linked", "token"])


def _thin(members: DataFrame, space: Workspace, percent: int, block_shingles: int, rounds: int, **limit) -> tuple[list[DataFrame], list[DataFrame]]:
    """(links, families that a task can settle or that are left) of ``members(d, family, root, set)``."""
    links, ready = [], []
    for i in range(rounds):
        total = members.groupBy("family").agg((F.sum(F.octet_length("set")) / 8).alias("total"))
        large = space.put(total.where(F.col("total") > block_shingles).select("family"), f"large-{i}")
        if large.isEmpty():
            break
        ready.append(members.join(large, "family", "left_anti").select("d", "family", "root", "set"))
        big = members.join(large, "family", "left_semi")
        nth = F.row_number().over(Window.partitionBy("family").orderBy(F.xxhash64("d")))
        sample = big.withColumn("nth", nth).where(F.col("nth") <= PIVOT_SAMPLE).select("family", "d", "set")
        pivots = space.put(sample.groupBy("family").applyInArrow(_pivot, "family long, p long, pivot binary"), f"pivots-{i}")
        against = big.join(pivots, "family").select("d", "family", "root", "set", "p", "pivot")
        judged = space.put(against.mapInArrow(_against_pivot(percent), "d long, family long, root long, set binary, p long, linked boolean, free boolean, n long, beyond binary"), f"judged-{i}")
        links.append(judged.where("linked AND d <> p").select(F.col("p").alias("a"), F.col("d").alias("b")))
        tokens = judged.select("d", "family", "linked", "beyond").mapInArrow(_tokens, "d long, family long, linked boolean, token long")
        shared = tokens.groupBy("family", "token").agg(F.min("d").alias("a"), F.max("d").alias("z"), F.bool_and("linked").alias("done")).where("a < z AND NOT done").select("family", "token", "a")
        edges = tokens.join(shared, ["family", "token"]).where("d <> a").select("a", F.col("d").alias("b"))
        # Neither linked nor free: much of it is in the pivot, which is longer. It may be linked to any as short.
        inside = judged.where("NOT linked AND NOT free").groupBy("family").agg(F.min("d").alias("a"), F.max("n").alias("most"))
        short = judged.where("linked OR NOT free").join(inside, "family").where((F.col("n") * percent <= F.col("most") * 100) & (F.col("d") != F.col("a")))
        found = components(edges.unionByName(short.select("a", F.col("d").alias("b"))), space, f"groups-{i}", **limit)
        root = F.when(F.col("linked"), F.col("p")).otherwise(F.col("root"))
        members = judged.join(found.withColumnRenamed("node", "d"), "d").select("d", F.col("label").alias("family"), root.alias("root"), "set")
    return links, [*ready, members]


def near_duplicates(docs: DataFrame, percent: int = 85, distance: int = DISTANCE, block_shingles: int = BLOCK_SHINGLES, local_edges: int | None = None, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Words are runs of non-blank characters with A-Z lower-cased; a document's
    set are its distinct runs of five words, or all its words as one with fewer.
    Documents are linked where 100 * intersection >= percent * union; a
    component is named by its smallest doc_id, and that document is kept.

    A null or empty text has no set and is linked with nothing, and so is a row
    with a null doc_id (component_id null, kept). Rows that repeat a doc_id are
    one document: links of any of them count. Equal sets are one class, so
    copies are never paired. Extra columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    read_few(spark)
    space = Workspace(spark, "near")
    limit = {} if local_edges is None else {"local_edges": local_edges}
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))
    sketch = space.put(rows.mapInArrow(_sketch, "d long, th long, n long, k1 long, k2 long, sig binary"), "sketch")
    known = sketch.where((F.col("n") > 0) & (F.col("d") != NO_ID))
    classes = space.put(known.groupBy("k1", "k2").agg(F.min(F.struct("d", "th")).alias("rep"), F.min("n").alias("n"), F.first("sig").alias("sig")).select("k1", "k2", "rep.d", "rep.th", "n", "sig"), "classes")
    # A class is named by its smallest doc_id; one doc_id may name several (repeated ids).
    keys = classes.select("d", "sig").mapInArrow(_keys(distance), "key long, d long")
    stars = keys.groupBy("key").agg(F.min("d").alias("a"), F.max("d").alias("z")).where("a < z").select("key", "a")
    edges = keys.join(stars, "key").where("d <> a").select("a", F.col("d").alias("b")).distinct()
    families = components(edges, space, "families", **limit)
    release(spark)
    sized = families.join(classes.select(F.col("d").alias("node"), "th", "n"), "node")
    totals = sized.groupBy("label").agg(F.sum("n").alias("total")).select("label", F.ceil(F.col("total") / block_shingles).cast("int").alias("blocks"))
    ids = space.put(sized.join(totals, "label").select(F.col("node").alias("d"), "th", F.col("label").alias("family"), "blocks"), "ids")
    sets = pick(rows, ids, ["d", "th"]).select("d", "family", "blocks", "text").mapInArrow(_sets, "d long, family long, blocks int, set binary").distinct()
    alone = sets.where("blocks = 1").select("d", "family", F.col("d").alias("root"), "set", F.lit(1).alias("blocks"))
    links, dealt = [], alone
    if not ids.where("blocks > 1").isEmpty():
        members = space.put(sets.where("blocks > 1").select("d", "family", F.col("d").alias("root"), "set"), "members")
        links, rest = _thin(members, space, percent, block_shingles, rounds, **limit)
        for i, part in enumerate(rest):
            # Groups of different rounds are different families.
            part = space.put(part.withColumn("family", F.xxhash64("family", F.lit(i))), f"rest-{i}")
            blocks = part.groupBy("family").agg(F.ceil(F.sum(F.octet_length("set")) / 8 / block_shingles).cast("int").alias("blocks"))
            dealt = dealt.unionByName(part.join(blocks, "family").select("d", "family", "root", "set", "blocks"))
    block = F.pmod(F.xxhash64("d"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("d", "family", "root", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "set")
    confirmed = space.put(dealt.groupBy("family", "x", "y").applyInArrow(_unit(percent), PAIR), "links")
    for more in links:
        confirmed = confirmed.unionByName(more)
    links = confirmed
    # Repeated doc_ids in several classes connect these.
    named = known.select("d", "k1", "k2").join(classes.select("k1", "k2", F.col("d").alias("rep")), ["k1", "k2"]).select("d", "rep")
    twice = named.groupBy("d").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("d", "a")
    again = named.join(twice, "d").where("rep <> a").select("a", F.col("rep").alias("b"))
    found = components(links.unionByName(again), space, "links-of", **limit).withColumnRenamed("node", "rep")
    release(spark)
    label = named.distinct().join(found, "rep", "left").groupBy("d").agg(F.min(F.coalesce("label", "rep")).alias("label"))
    out = sketch.select("d", "n").join(label, "d", "left")
    doc, part = F.when(F.col("d") != NO_ID, F.col("d")), F.when(F.col("d") != NO_ID, F.coalesce("label", "d"))
    return out.select(doc.alias("doc_id"), F.col("n").alias("n_shingles"), part.alias("component_id"), F.coalesce(doc == part, F.lit(True)).alias("kept"))


def without_copies(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, of one document of each group.

    Of rows that repeat a doc_id one stays. Rows with a null doc_id all stay.
    """
    space = Workspace(docs.sparkSession, "copies")
    gone = space.put(near_duplicates(docs, percent).where(~F.col("kept")).select("doc_id").distinct(), "gone")
    left = pick(docs, gone, ["doc_id"], "left_anti")
    twice = space.put(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "twice")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    name = "nth"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    one = pick(left, twice, ["doc_id"], "left_semi").withColumn(name, nth).where(F.col(name) == 1).drop(name)
    return pick(left, twice, ["doc_id"], "left_anti").unionByName(one)


def op4_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS g FROM x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
l AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT node, min(seen) AS c FROM r GROUP BY node) m ON d.doc_id = m.node
"""
