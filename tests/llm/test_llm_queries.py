"""The registered queries against their SQL or plain Python, and the pipeline."""

import base64
import hashlib
import zlib

import numpy as np
import pytest
from compare import same

from millrace.llm.registry import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_agrees_with_its_sql(name, spark, small, duck):
    same(queries()[name](spark, small), duck, oracle_sql()[name])


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))


def texts(duck):
    return duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def test_op3(spark, small, duck):
    got = {r.doc_id: r for r in queries()["op3_mpeg_audio"](spark, small).collect()}
    rows = texts(duck)
    assert len(got) == len(rows)
    for d, t in rows:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert len(r.media_sha256) == 64 and r.media_bytes > r.payload_bytes


def test_op4(spark, small, duck):
    from llm_tables import near_components

    got = {r.doc_id: r.component_id for r in queries()["op4_near_dedup"](spark, small).collect()}
    assert got == near_components(texts(duck))


def test_op8(spark, small, duck):
    rows = duck.execute("SELECT page_id, coalesce(html, '') FROM pages").fetchall()
    last = {}
    for p, h in rows:
        last[h] = max(p, last.get(h, p))
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries()["op8_arc_warc"](spark, small).collect()}
    for p, h in rows:
        sha = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        assert got[p] == (len(h.encode()), sha, "response" if last[h] == p else "revisit", None if last[h] == p else last[h])


def test_op9(spark, small, duck):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries()["op9_token_store"](spark, small).collect()}
    at = 0
    for d, t in texts(duck):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert got[d] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_pipeline(spark, small, duck):
    import corpus_pipeline as p
    from llm_tables import near_components

    assert [n for n, _ in p.STAGES] == ["language_id", "near_duplicates", "decontaminate", "mix_sources", "token_ids"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    cols, counts = docs.columns, [docs.count()]
    from millrace.llm.common import Workspace

    space = Workspace(spark, "t")
    for name, stage in p.STAGES[:-1]:
        before = docs
        docs = space.put(stage(spark, docs, small), name)
        assert docs.columns == cols
        counts.append(docs.count())
        if name == "near_duplicates":
            groups = near_components([(r.doc_id, r.text) for r in before.collect()], 80)
            assert sorted(r.doc_id for r in docs.collect()) == sorted(d for d, c in groups.items() if d == c)
        if name == "decontaminate":
            from millrace.llm.containment import find_items

            hit = {r.doc_id for r in find_items(before, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
            assert {r.doc_id for r in before.collect()} - hit == {r.doc_id for r in docs.collect()}
    assert counts[1] >= 0.95 * counts[0]
    out = p.run(spark, small).collect()
    assert len(out) == counts[-1] and min(r.start for r in out) == 0
