"""Each operator on awkward rows, against plain Python, and on empty tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_tables import BASE, CLASH, DOCS, LINE, SCHEMA, docs, kept_lines, near_components, removed_words, shingles, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import arc_warc, containment, crf_language, graph, line_dedup, mixing, mpeg_audio, near_dedup, substring_index, token_store, url_reputation
from millrace.llm.common import Workspace
from millrace.llm.words import Words, shingle_sets, text_buffer

IDS = -(1 << 63)
ROWS = [(d, t) for d, t, *_ in DOCS]


def as_rows(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


# --- hashing ------------------------------------------------------------------


def test_hashes_do_not_depend_on_the_stretch():
    """Words of a buffer longer than a stretch, and a word longer than one."""
    raw = ("ab c " * 700_000 + "x" * 1_200_000 + " tail ab").encode()
    w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    h = w.hashes()
    one = Words(*text_buffer(pa.array(["ab c tail"]))).hashes()
    assert (h[:1_400_000:2] == one[0]).all() and (h[1:1_400_000:2] == one[1]).all() and (h[-2], h[-1]) == (one[2], one[0])


def test_words_and_shingles_match_plain_python():
    texts = [t for _, t in ROWS]
    w = Words(*text_buffer(pa.array(texts, pa.string())))
    assert w.counts.tolist() == [len(words(t)) for t in texts]
    h, o = shingle_sets(w)
    assert np.diff(o).tolist() == [len(shingles(t)) for t in texts]
    sets = [set(h[a:b].tolist()) for a, b in zip(o[:-1], o[1:])]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            assert len(sets[i] & sets[j]) == len(shingles(a) & shingles(b))


# --- 1 ------------------------------------------------------------------------

URLS = [
    (1, "https://www.example.com/en/x?q", "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
    (3, "http://EXAMPLE.com", "example.com", "", None, "allow"), (4, "http://shop.com/a", "shop.com", "/a", "com/", "allow"), (5, "http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    (6, "http://x.net/de/1", "x.net", "/de/1", None, "allow"), (7, None, "", "", None, "allow"), (8, "no scheme", "", "", None, "allow"), (9, "x://h#frag/en/", "h", "", None, "allow"),
    (10, "http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), (None, "http://net/fr/", "net", "/fr/", "net/fr/", "block"), (11, "a://b://c/d", "b:", "//c/d", None, "allow"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([r[:2] for r in URLS], "page_id long, url string").selectExpr("*", "1 AS host", "2 AS n", "3 AS good")
    out = url_reputation.filter_urls(pages, spark.createDataFrame([], "page_id long, good long"))
    assert as_rows(out, "page_id", "host", "path", "rule", "verdict") == Counter((i, h, p, r, v) for i, _, h, p, r, v in URLS)


def test_bad_hosts_are_blocked_and_little_known_ones_follow_their_domain(spark):
    rows = [(i, f"http://bad.org/{i}", 0) for i in range(60)] + [(100 + i, f"http://good.org/{i}", 1) for i in range(60)] + [(200 + i, f"http://s{i}.worse.io/", 0) for i in range(60)]
    extra = [(300, "http://new.worse.io/", None), (301, "http://new.good.org/", None), (302, "http://one.org/", 0)]
    pages = spark.createDataFrame([r[:2] for r in rows + extra], "page_id long, url string")
    known = spark.createDataFrame([(r[0], r[2]) for r in rows + extra], "page_id long, good int")
    out = {r.page_id: r.verdict for r in url_reputation.filter_urls(pages, known, rules=()).collect()}
    assert {out[i] for i in range(60)} == {"block"} and {out[100 + i] for i in range(60)} == {"allow"}
    assert out[300] == "block" and out[301] == "allow" and out[302] == "allow"


def test_null_domains_and_suffixes_are_units(spark):
    rows = [("a.com", "com", "a.com", 3.0, 1.0), ("x", None, None, 2.0, 2.0), ("y", "com", None, 1.0, 0.0), (None, None, "z", 0.0, 0.0)]
    got = {r.host: r for r in url_reputation.reputation(spark.createDataFrame(rows, "host string, suffix string, domain string, n double, good double")).collect()}
    assert set(got) == {"a.com", "x", "y", None} and all(0 <= r.post_mean <= r.upper <= 1 for r in got.values())


def test_ports_users_and_addresses(spark):
    hosts = {
        "a.b.example.com:8080": ("com", "example.com"), "me:pw@x.co.uk": ("co.uk", "x.co.uk"), "10.1.2.3:80": ("10.1.2.3", "10.1.2.3"), "[::1]:8080": ("[::1]", "[::1]"),
        "example.com.": ("com", "example.com"), "": ("", ""), "localhost": ("localhost", "localhost"), "1.2.3.4.com": ("com", "4.com"),
    }
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    suffix, domain = url_reputation.host_ladder(F.col("host"))
    assert {r.host: (r.s, r.d) for r in df.select("host", suffix.alias("s"), domain.alias("d")).collect()} == hosts
    assert df.where("host like 'me%'").select(url_reputation.host_ladder(F.col("host"), ())[1]).first()[0] == "co.uk"


def test_urls_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_reputation.filter_urls(pages, spark.createDataFrame([], "page_id long, good long")).count() == 0


# --- 2 ------------------------------------------------------------------------


def test_containment(spark):
    items = [(1, "One two three four five six seven eight nine ten"), (2, "tiny item"), (3, ""), (4, None), (5, BASE[:200]), (None, "nul byte"), (1, "One two three four five six seven eight nine ten")]
    texts = [(1, "x, " * 300 + "one TWO three four; five six seven eight nine ten " + "y " * 300), (2, "one two three four five six seven"), (3, "a tiny\nitem here"), (4, None), (5, BASE), (None, "one two three four five six seven eight nine ten"), (6, "\x00 nul \x1f byte")]
    d = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS n_item")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    want = Counter()
    norm = lambda t: [w for w in "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in (t or "").lower()).split()]
    runs = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    for i, t in items:
        w = norm(t)
        if w:
            s = runs(w, min(5, len(w)))
            for doc, text in texts:
                got = len(s & runs(norm(text), min(5, len(w))))
                if 10 * got >= 8 * len(s):
                    want[(doc, i, len(s), got)] += 1
    for block_bytes in (1 << 20, 60):
        assert as_rows(containment.find_items(d, b, index_bytes=block_bytes), "doc_id", "item_id", "n_item", "n_shared") == want
    kept = containment.without_items(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {2, 4}
    assert containment.find_items(d.limit(0), b).count() == 0 and containment.find_items(d, b.limit(0)).count() == 0


def test_containment_finds_every_item_at_the_threshold():
    """Items with a fifth of their shingles broken, inside long texts: none is missed."""
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(5000)]
    items = [" ".join(rng.choices(vocabulary, k=rng.randint(12, 60))) for _ in range(60)]
    index = containment.Index(list(range(60)), items)
    texts, want = [], set()
    for i, item in enumerate(items):
        w = item.split()
        q = len(shingles(item))
        cut = q // 5  # words changed at the end break at most that many shingles
        w = w[: len(w) - cut] + ["zz"] * cut
        texts.append(" ".join(rng.choices(vocabulary, k=3000) + w + rng.choices(vocabulary, k=3000)))
        want.add((i, i))
    found = {(row, j) for row, j, q, shared in index.search(pa.array(texts))}
    assert want <= found


# --- 3 ------------------------------------------------------------------------


def test_audio_round_trip_and_digest(spark):
    stored = mpeg_audio.store_texts(docs(spark), Workspace(spark, "t"))
    got = {}
    for doc_id, media in [(r.doc_id, bytes(r.media)) for r in stored.collect()]:
        a = mpeg_audio.parse(media)
        got.setdefault(doc_id, []).append(a.payload)
        assert not a.crc_bad and not a.skipped and a.rate == 48000 and a.samples == 1152 * len(a.offsets)
        assert a.table["frames"] == len(a.offsets) and all(media[o] == 0xFF for o in a.offsets)
    for d, t in ROWS:
        assert mpeg_audio.text_payload(t)[0] in got[d]
    assert as_rows(mpeg_audio.audio_columns(stored), "doc_id") == Counter((d,) for d, _ in ROWS)
    assert mpeg_audio.store_texts(docs(spark).limit(0), Workspace(spark, "t")).count() == 0


def test_payload_padding():
    assert mpeg_audio.text_payload(None) == (bytes(64), 0)
    assert mpeg_audio.text_payload("x" * 64) == (b"x" * 64, 64)
    assert len(mpeg_audio.text_payload("x" * 65)[0]) == 128


@pytest.mark.parametrize("size", [64, 937, 938, 960, 5000])
def test_audio_resynchronises(size):
    payload = random.Random(size).randbytes(size) + b"\xff\xfb\xff\xfa" * 40
    media = mpeg_audio.encode(payload, {"title": "é"})
    assert mpeg_audio.parse(media).payload == payload
    dirty = b"junk\xff\xfbjunk" + media[media.index(b"\xff\xfa") :]
    a = mpeg_audio.parse(dirty)
    assert a.skipped == 10 and a.table["frames"] == len(a.offsets)
    broken = bytearray(media)
    at = mpeg_audio.parse(media).offsets[0]
    broken[at + 10] ^= 1
    b = mpeg_audio.parse(bytes(broken))
    assert b.crc_bad == 1 and len(b.offsets) == len(mpeg_audio.parse(media).offsets)


def test_audio_header_and_tags():
    h = mpeg_audio.header(bytes([0xFF, 0xFB, 0x90, 0x00]))  # 128 kbps, 44100 Hz, stereo, no checksum
    assert (h.version, h.layer, h.kbps, h.rate, h.length, h.samples, h.mono) == (1.0, 3, 128, 44100, 417, 1152, False)
    assert mpeg_audio.header(b"\xff\xe0\x00\x00") is None and mpeg_audio.header(b"RIFF") is None
    assert mpeg_audio.parse(b"").samples == 0 and mpeg_audio.parse(b"\xff" * 50).samples == 0


# --- 4 ------------------------------------------------------------------------


def test_near_duplicates_on_awkward_rows(spark):
    want = near_components(ROWS)
    got = near_dedup.near_duplicates(docs(spark)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
            assert r.n_shingles in {len(shingles(t)) for d, t in ROWS if d == r.doc_id}
    assert near_dedup.near_duplicates(docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("options", [{}, {"block_shingles": 300, "local_edges": 0}, {"block_shingles": 300, "rounds": 0}, {"block_shingles": 1500, "rounds": 1}])
def test_near_duplicates_of_a_family(spark, options):
    """Copies of one text with ever more changes: links at every similarity, chains among them."""
    rng = random.Random(5)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"e{i}_{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"u{i}_{j}" for j in range(30))) for i in range(20)]
    # Excerpts of the text, shorter by and by: neighbours are linked, far ones aren't.
    rows += [(200 + i, " ".join(base[: 110 - 5 * i])) for i in range(12)]
    want = near_components(rows)
    assert 2 < len({c for d, c in want.items() if d < 100}) < 90
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()}
    assert got == want


def test_repeated_ids_connect_their_texts(spark):
    rows = [(5, BASE), (5, "x " * 30), (3, BASE + " tail"), (9, "x " * 31)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 3, 3: 3, 9: 3}


def test_signatures_within_the_distance_share_a_key():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 65536, (400, near_dedup.HASHES)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(near_dedup.HASHES, near_dedup.DISTANCE, replace=False)
        row[at] ^= rng.integers(1, 65536, len(at)).astype(np.uint16)
    assert (near_dedup.keys_of(a) == near_dedup.keys_of(b)).any(1).all()


def test_one_document_of_each_group_stays(spark):
    out = near_dedup.without_copies(docs(spark))
    assert out.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), *CLASH]
    ids = [r.doc_id for r in out.collect()]
    groups = near_components(ROWS, 80)
    assert sorted(i for i in ids if i is not None) == sorted({d for d, c in groups.items() if d == c}) and ids.count(None) == 2


@pytest.mark.parametrize("local", [0, 10**6])
def test_components(spark, local):
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(7, 7), (1, 0), (100, 3)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t"), "c", local).collect()}
    assert got == {i: i // 20 * 20 for i in range(60)} | {100: 0}
    assert graph.components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t"), "c", local).count() == 0


# --- 5 ------------------------------------------------------------------------


def test_marginals_match_all_paths():
    from itertools import product

    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        e, t, s = rng.normal(size=(n, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
        p = np.zeros((n, 3))
        for y in product(range(3), repeat=n):
            weight = np.exp(s[y[0]] + sum(e[i, y[i]] for i in range(n)) + sum(t[y[i - 1], y[i]] for i in range(1, n)))
            for i in range(n):
                p[i, y[i]] += weight
        assert np.allclose(p / p.sum(1, keepdims=True), crf_language.marginals(e, np.array([0, n]), t, s))


def test_expected_transitions_match_all_paths():
    rng = np.random.default_rng(1)
    k, first = 3, np.array([0, 4, 4, 5, 8])
    emit, trans, start = rng.normal(size=(8, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    p, ahead = crf_language.forward_backward(emit, first, trans, start)
    right = np.array([i for a, b in zip(first[:-1], first[1:]) for i in range(a + 1, b)])
    want = np.zeros((k, k))
    for a, b in zip(first[:-1], first[1:]):
        paths = list(np.ndindex(*[k] * (b - a)))
        score = [np.exp(start[y[0]] + sum(emit[a + i, v] for i, v in enumerate(y)) + sum(trans[u, v] for u, v in zip(y, y[1:]))) if y else 1.0 for y in paths]
        for y, s in zip(paths, score):
            for u, v in zip(y, y[1:]):
                want[u, v] += s / sum(score)
    assert np.allclose(crf_language.transitions(p, ahead, right, trans), want)


def test_the_training_sample_is_bounded_and_even(spark):
    rows = [(i, f"text {i}", "en" if i % 10 else f"l{i % 70}", "s") for i in range(1, 3001)] + [(7, "text 7", "en", "s")] * 500
    got = crf_language.training_rows(spark.createDataFrame(rows, SCHEMA), rows=60, labels=3)
    count = Counter(y for y, _ in got)
    assert len(count) == 3 and count["en"] == 20 and max(count.values()) <= 20 and len(set(got)) == len(got)


def test_language_on_awkward_rows(spark):
    got = crf_language.identify(docs(spark)).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in ROWS)
    for r in got:
        assert 0 <= r.score <= 1 and r.lang_pred in {"en", "de", "fr", "und"}
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {5, 6, 7, 12} <= und and not und & {1, 2, 4, 8, 10, -4}
    assert crf_language.identify(docs(spark).limit(0)).count() == 0
    nothing = crf_language.identify(docs(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_language_of_held_out_documents(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    rows = crf_language.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.97


def test_language_switches_inside_a_text(small, spark):
    rows = crf_language.training_rows(spark.read.parquet(f"{small}/documents.parquet"))
    model = crf_language.train(rows)
    a, b = (next(t for y, t in sorted(rows) if y == lang and len(t) > 1500).lower() for lang in model.labels[:2])
    text = " ".join(a.split()[:60] + b.split()[:60])
    w = crf_language._fold(*text_buffer(pa.array([text])))
    label = model.words(w).argmax(1)
    half = len(label) // 2
    assert (label[: half - 8] == 0).mean() > 0.85 and (label[half + 8 :] == 1).mean() > 0.85


def test_rejected_languages_go(spark, small):
    d = docs(spark)
    model = crf_language.train(crf_language.training_rows(spark.read.parquet(f"{small}/documents.parquet")))
    out = crf_language.with_language(d, model, 0.0)
    assert out.columns == d.columns and not {r.doc_id for r in out.collect()} & {5, 6, 7, 12}
    assert crf_language.with_language(d.limit(0), model).count() == 0


# --- 6 ------------------------------------------------------------------------


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_substrings_on_awkward_rows(spark, batches):
    rows = [(IDS if d is None else d, t) for d, t in ROWS]
    want = Counter((None if d == IDS else d, n, gone, hashlib.sha256(" ".join(kept).encode()).hexdigest()) for d, n, gone, kept in removed_words(rows))
    got = as_rows(substring_index.dedup(docs(spark), batches), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == want
    assert substring_index.dedup(docs(spark).limit(0), batches).count() == 0


def test_an_index_grows_in_two_sessions(spark):
    """Batches added by different sessions give what one pass over all gives; rows are rewritten once a level."""
    rng = random.Random(2)
    passages = [" ".join(rng.choices([f"p{i}" for i in range(300)], k=30)) for _ in range(6)]
    rows = [(i, " ".join([" ".join(rng.choices([f"q{k}" for k in range(400)], k=20)), *rng.sample(passages, rng.randint(0, 2)), f"tail {i}"])) for i in range(1, 41)]
    rows += [(41, rows[3][1]), (42, rows[40 - 30][1])]
    df = spark.createDataFrame(rows, "d long, text string")
    path = Workspace(spark, "t").path + "/index"
    tables = {t.name for t in spark.catalog.listTables()}
    got, sizes = Counter(), []
    for session, ranges in ((spark, [(0, 10), (10, 20), (20, 25)]), (spark.newSession(), [(25, 40), (40, 42)])):
        own = session.createDataFrame(rows, "d long, text string")
        with substring_index.SubstringIndex(session, path) as index:
            for low, high in ranges:
                out = index.add(own.where((F.col("d") > low) & (F.col("d") <= high)), own)
                got += as_rows(out, "d", "n_words", "n_removed", "kept_sha256")
                sizes.append(sum(session.table(r["name"]).count() for r in index.runs))
            assert all(len([r for r in index.runs if (r["kind"], r["level"]) == (k, n)]) < 2 for k in substring_index.KINDS for n in range(4))
            with pytest.raises(ValueError):
                index.add(own.where("d = 7"), own)
            rewritten, runs = index.rewritten, index.runs
    assert got == Counter((d, n, gone, hashlib.sha256(" ".join(kept).encode()).hexdigest()) for d, n, gone, kept in removed_words(rows))
    assert {t.name for t in spark.catalog.listTables()} == tables  # no run stays in the catalog
    # Five batches: the first two are rewritten twice, the third and fourth too, the last not at all.
    assert {(r["kind"], r["level"]) for r in runs} == {(k, n) for k in substring_index.KINDS for n in (0, 2)}
    assert rewritten <= 2 * sizes[3] + sizes[0]
    assert df.count() == 42


def test_hot_fingerprints_and_the_two_families():
    words = Words(*text_buffer(pa.array([BASE])), lower=False)
    at, fp, (w, v) = substring_index.windows(words, full=True)
    assert len(at) == words.n - 12 == len(set(w.tolist())) == len(set(v.tolist())) and not set(w.tolist()) & set(v.tolist()) and len(set(fp.tolist())) < len(at)


# --- 7 ------------------------------------------------------------------------


def test_lines_on_awkward_rows(spark):
    from millrace.llm.line_dedup import line_bitmaps
    from millrace.llm.line_dedup import kept_lines as unpack

    rows = [(IDS if d is None else d, t) for d, t in ROWS]
    want = {(d, t): (n, gone, text) for (d, n, gone, text), (_, t) in zip(kept_lines(rows), rows)}
    assert any(gone for _, gone, _ in want.values())
    texts = {(r.d, r.th): (r.n_lines, r.n_dropped, r.keep) for r in line_bitmaps(docs(spark)).collect()}
    keyed = {(r.d, r.th): r.text for r in line_dedup._keyed(docs(spark)).collect()}
    assert texts.keys() == keyed.keys()
    for key, (n, gone, keep) in texts.items():
        t = keyed[key]
        lines = (t or "").split("\n")
        left = "\n".join(x for x, k in zip(lines, unpack(keep, n)) if k)
        assert (n, gone, left) == want[(key[0], t)]
    assert line_bitmaps(docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_lines_stream_in_any_batches(seed):
    """Sorted rows, cut anywhere into runs and batches, give what the whole gives."""
    rng = random.Random(seed)
    rows = sorted({(rng.choice([1, 2, 3, 9]), rng.choice([0, 5]), d, 0, p) for d in range(rng.choice([3, 30])) for p in range(rng.choice([1, 6])) if rng.random() < 0.6}, key=lambda r: (r[0], r[1], -r[2], r[4]))
    held = {}
    for r in rows:
        held.setdefault(r[:2], set()).add(r[2])
    want = Counter((r[2], r[4], r[:2]) for r in rows if len(held[r[:2]]) >= 5 and r[2] != max(held[r[:2]]))
    cuts = [i for i in range(1, len(rows)) if rows[i][:3] != rows[i - 1][:3] and rng.random() < 0.2]  # equal keys and documents share a run
    got, waits, open_keys = Counter(), [], {}
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        batches, at = [], a
        while at < b:
            n = rng.randint(1, 4)
            part = rows[at : min(b, at + n)]
            batches.append(pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.int64()) for i in range(5)], list("abcde")))
            at += n
        ends = 0
        for out in line_dedup._drops(5)(iter(batches)):
            for kind, h1, h2, d, _, place, n in zip(*[c.to_pylist() for c in out.columns]):
                if kind == 0:
                    got[(d, place, (h1, h2))] += 1
                elif kind == 1:
                    waits.append((d, place, (h1, h2)))
                else:
                    ends += 1
                    docs_, top = open_keys.get((h1, h2), (0, d))
                    open_keys[(h1, h2)] = (docs_ + n, max(top, d))
        assert ends <= 2
    for d, place, key in waits:
        n, top = open_keys[key]
        got[(d, place, key)] += n >= 5 and d != top
    assert +got == want


def test_a_line_in_many_runs(spark):
    rows = [(i, LINE + f"\nown {i}") for i in range(300)]
    got = line_dedup.line_bitmaps(spark.createDataFrame(rows, "doc_id long, text string").repartition(16)).collect()
    assert {r.d for r in got if r.n_dropped == 0} == {299} and all(r.n_dropped == 1 for r in got if r.d < 299)


# --- 8 ------------------------------------------------------------------------

PAGES = [(1, "http://a/ b", "<p>x"), (2, "http://b", "<p>x"), (3, None, None), (4, "http://c\n", ""), (5, "http://d", "é\r\n\r\nWARC/1.1\r\n"), (None, "http://e", "<p>x"), (None, None, "only"), (7, "http://f", "z" * 300_000), (2, "http://b", "<p>x")]


@pytest.mark.parametrize("least", [0, 4, 1000])
def test_archives(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS sha", "2 AS lead")
    got = as_rows(arc_warc.read_archives(arc_warc.write_archives(pages, Workspace(spark, "t"), least, 50_000)), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = Counter()
    for p, _, h in PAGES:
        data = (h or "").encode()
        group = [q for q, _, x in PAGES if (x or "") == (h or "") and q is not None]
        top = max(group, default=None)
        first = len(data) < least or top is None or p == top
        want[(p, len(data), arc_warc.digest(data), "response" if first else "revisit", None if first else top)] += 1
    assert got == want


def test_record_ids_are_the_pages_own(spark):
    """Pages of one url and payload, whose dates are the same."""
    far = 250_000_000_000
    pages = spark.createDataFrame([(1, "http://a/", "x"), (1 + far, "http://a/", "x"), (1 + 2 * far, "http://a/", "y")], "page_id long, url string, html string")
    space = Workspace(spark, "t")
    names = []
    for r in arc_warc.write_archives(pages, space).collect():
        names += [f["warc-record-id"] for f, _ in arc_warc.read_warc(bytes(r.data)) if f["warc-type"] != "warcinfo"]
    assert len(set(names)) == 3
    got = {r.page_id: (r.record_type, r.refers_to) for r in arc_warc.read_archives(arc_warc.write_archives(pages, space, name="again")).collect()}
    assert got == {1: ("revisit", 1 + far), 1 + far: ("response", None), 1 + 2 * far: ("response", None)}


def test_arc_versions():
    r = arc_warc.ArcRecord("http://x/%20", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\n\n")
    for version in (1, 2):
        assert list(arc_warc.read_arc(arc_warc.arc_bytes([r, r], "n.arc", version))) == [r, r]
    (fields, block), = arc_warc.read_warc(arc_warc.to_warc(r))
    assert fields["warc-date"] == "2001-02-03T04:05:06Z" and fields["warc-type"] == "response" and block == r.body
    (fields, block), = arc_warc.read_warc(arc_warc.to_warc(r, ("http://y", "20010203040507", b"")))
    assert fields["warc-type"] == "revisit" and block.endswith(b"\r\n\r\n") and fields["warc-refers-to"] == arc_warc.record_id("http://y", "20010203040507", arc_warc.digest(b"body\n\n"))
    plain = arc_warc.ArcRecord("dns:x", "0.0.0.0", "2001", "text/dns", b"raw")
    assert next(arc_warc.read_warc(arc_warc.to_warc(plain)))[0]["warc-type"] == "resource"
    for bad in (b"x\n", b"filedesc://a 0 0 t 99\n1 0\n", b"filedesc://a 0 0 t 4\n9 0\n\n"):
        with pytest.raises(ValueError):
            list(arc_warc.read_arc(bad))


def test_archives_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert arc_warc.read_archives(arc_warc.write_archives(pages, Workspace(spark, "t"))).count() == 0


# --- 9 ------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
def test_blocks(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 50257, n).astype(np.uint32)
    ids[::5] = rng.integers(0, 2**32, len(ids[::5]))
    ids[300:700] = 7
    s = token_store.Segment(token_store.encode_segment(ids, np.array([0, n])))
    assert (s.ids() == ids).all()
    for _ in range(30):
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert (s.ids(a, b) == ids[a:b]).all()


def test_words_apart_encode_like_whole_texts():
    enc = token_store.Encoder(token_store.vocabulary())
    parts = [" ", "  ", "\n", " \n", "\n ", "a", "B", "'s", "é", "1", "!", "\x1c", "\t", "ß中", "\u00a0", "\u3000", "\x85", "À", ".", "word", "\x00", "!!", "$$", "'", "_", "<|", "|>", "<|endoftext|>", "endoftext"]
    rng = random.Random(0)
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(20_000)] + [t or "" for _, t in ROWS]
    ids, count = enc.encode(*text_buffer(pa.array(texts)))
    tok = Tokenizer.from_file(token_store.vocabulary())
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert any(50256 in w for w in want)
    assert count.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_tokens_on_awkward_rows(spark):
    got = token_store.store(docs(spark)).collect()
    tok = Tokenizer.from_file(token_store.vocabulary())
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at, want = 0, Counter()
    for d, t in order:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want[(d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        at += len(ids)
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
    assert token_store.store(docs(spark).limit(0)).count() == 0


def test_small_segments(spark):
    space = Workspace(spark, "t")
    seg = token_store.write_tokens(docs(spark), token_store.vocabulary(), space, segment_ids=50)
    assert seg.count() > 4
    assert as_rows(token_store.read_tokens(seg), "doc_id", "start", "n_tokens", "ids_crc32") == as_rows(token_store.store(docs(spark)), "doc_id", "start", "n_tokens", "ids_crc32")


# --- 10 -----------------------------------------------------------------------


def targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, free, out = sum(sizes.values()), set(names), {}
    left = total
    while True:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            left -= most * sizes[s]
            free.discard(s)
        if not free:
            return out


def test_mix_on_awkward_rows(spark):
    got = mixing.mix(docs(spark)).collect()
    assert len(got) == len(DOCS)
    sizes, taken = Counter(), Counter()
    by_id = {}
    for d, t, _, s in DOCS:
        sizes[s] += len(words(t))
        by_id[(d, len(words(t)))] = s
    want = targets(dict(sizes))
    for r in got:
        s = by_id[(r.doc_id, r.size)]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    assert mixing.mix(docs(spark).limit(0)).count() == 0


def test_mix_runs_agree_and_shares_are_resharded(spark):
    rows = [(i, "w " * (i % 7 + 1), "en", s) for i in range(400) for s in ([None, "a", "b", "c"][min(3, i % 40)],)]
    df = spark.createDataFrame(rows, SCHEMA)
    first = as_rows(mixing.mix(df), "doc_id", "taken")
    assert first == as_rows(mixing.mix(df.repartition(7)), "doc_id", "taken")
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    want = targets(dict(sizes))
    got = {r.source: r.t for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).withColumnRenamed("target", "t").collect()}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_has_no_python_in_its_plan(spark):
    plan = mixing.mix(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_mixed_rows_repeat(spark):
    d = docs(spark)
    out = mixing.mixed(d)
    copies = {(r.doc_id, r.size): r.copies for r in mixing.mix(d).collect()}
    assert out.columns == d.columns and out.count() == sum(r.copies for r in mixing.mix(d).collect()) and max(copies.values()) <= 3
