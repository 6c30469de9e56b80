"""The pipeline on nulls, empty and very long texts, repeated rows, clashing columns and empty tables, stage by stage."""

import re
from collections import Counter

import corpus_pipeline as p
import pyarrow as pa
import pytest
from llm_tables import BASE, DOCS, OTHER, docs, near_components, words

from millrace.llm import crf_language
from millrace.llm.common import Workspace

#: An item in OTHER, one in nothing, and three that hold no words.
ITEMS = [(1, " ".join(OTHER.split()[20:40])), (2, "an item that no document of this table has"), (3, None), (4, ""), (None, "?!")]


def saved(spark, folder, rows, items):
    docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def item_words(text):
    return [w for w in re.findall(r"(?:[0-9a-z]|[^\x00-\x7F])+", " ".join(words(text)))]


def holds(text, item):
    own, asked = item_words(text), item_words(item)
    k = min(5, len(asked))
    runs = lambda w: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return bool(asked) and 10 * len(runs(own) & runs(asked)) >= 8 * len(runs(asked))


def test_each_stage_on_awkward_rows(spark, tmp_path):
    where = saved(spark, tmp_path, DOCS, ITEMS)
    d = spark.read.parquet(f"{where}/documents.parquet")
    cols, space, seen = d.columns, Workspace(spark, "awkward"), {}
    for name, stage in p.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
        d = space.put(stage(spark, d, where), name)
        assert d.columns == cols
        seen[name] = (before, ids(d))

    before, after = seen["language_id"]
    model = crf_language.train(crf_language.training_rows(spark.read.parquet(f"{where}/documents.parquet")))
    names, _, sure = model.judged(pa.array([t for _, t in before], pa.string()))
    assert after == Counter(i for (i, _), n, s in zip(before, names, sure) if n != "und" and s >= 0.5)
    assert not {5, 6, 7, 12} & set(after) and {1, 4, 10, 11} <= set(after)

    before, after = seen["near_duplicates"]
    groups = near_components(before, 80)
    first = {i for i, c in groups.items() if i == c}
    assert after == Counter([*first, *[i for i, _ in before if i is None]])

    before, after = seen["decontaminate"]
    assert after == Counter(i for i, t in before if not any(holds(t or "", x or "") for _, x in ITEMS))
    assert 4 in {i for i, _ in before} and 4 not in after

    before, after = seen["mix_sources"]
    assert set(after) <= {i for i, _ in before} and all(n <= 3 * Counter(i for i, _ in before)[i] for i, n in after.items())

    out = p.run(spark, where).collect()
    assert Counter(r.doc_id for r in out) == after
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at and r.n_tokens >= 1
        at += r.n_tokens


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, BASE, None, "a")]])
def test_nothing_to_learn_from(spark, tmp_path, rows):
    where = saved(spark, tmp_path, rows, [])
    got = p.run(spark, where)
    assert {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(got.columns) and got.collect() == []


