"""Readers, writers, components and generators take every row of a table of 4,000 events."""

import re
from pathlib import Path

import pytest
from compare import same

from millrace.plans.everything import ORACLES, QUERIES


@pytest.fixture(scope="module")
def many(spark, small, tmp_path_factory):
    where = tmp_path_factory.mktemp("many")
    for p in Path(small).glob("*.parquet"):
        if p.stem != "events":
            (where / p.name).symlink_to(p)
    spark.range(0, 4000, 1, 2).selectExpr(
        "id AS event_id", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts", "id * 7 % 67 AS user_id",
        "element_at(array('view', 'click', 'error', 'signup', 'purchase'), cast(id * id % 11 % 5 AS int) + 1) AS event_type",
        "cast(id * 13 % 120 AS double) AS value", "concat('{\"k\": ', id * 31 % 100, '}') AS props",
    ).write.parquet(f"{where}/events.parquet")
    return str(where)


@pytest.fixture(scope="module")
def many_duck(many):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{many}/events.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n.startswith(("scan.", "sink.", "hash.", "graph.", "load.", "win.")) and re.search(r"\b(records|boxes)\b", ORACLES[n]) and not re.search(r"\b(cands|steps)\b AS", ORACLES[n])))
def test_query_over_more_rows_agrees_with_its_sql(name, spark, many, many_duck):
    same(QUERIES[name](spark, many), many_duck, ORACLES[name])


def test_components_of_all_rows(spark, many):
    """Against union-find over the keys, row by row."""
    up = list(range(4000))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    seen = {}
    for i in range(4000):
        for key in [("a", i // 7), *([("b", i // 35)] if i % 7 == 0 else [])]:
            a, b = top(seen.setdefault(key, i)), top(i)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in QUERIES["graph.components"](spark, many).collect()}
    assert got == {i: top(i) for i in range(4000)}


READERS = ["scan.ids.txt", "scan.json.array.streaming", "scan.json.doc", "scan.manifest", "scan.manifest.frozen", "scan.mixed", "scan.tar"]


@pytest.mark.parametrize("name", READERS)
def test_readers_get_every_row(name, spark, many):
    rows = QUERIES[f"{name}"](spark, many)
    assert (rows.agg({"n": "sum"}).first()[0] if "n" in rows.columns else rows.count()) == 4000


@pytest.mark.parametrize("name", ["scan.jsonl.lenient", "sink.jsonl", "sink.jsonl.atomic", "sink.parquet.arrow", "sink.parquet.batched", "sink.cache.step"])
def test_files_hold_every_row(name, spark, many):
    assert QUERIES[f"{name}"](spark, many).count() == 4000


def test_generators_get_every_row(spark, many):
    assert QUERIES["gen.positions"](spark, many).count() == 32000
    assert QUERIES["win.nearest_neighbor"](spark, many).count() == 4000


def test_a_key_that_conflicts_only_in_later_turns_is_excluded(spark, tmp_path):
    """Three splits of one k, two of them in rows with turns > 2."""
    spark.createDataFrame(
        [(0, 0, "view", 1.0, '{"k": 5}'), (5, 1, "view", 1.0, '{"k": 5}'), (6, 2, "view", 1.0, '{"k": 5}')], "event_id long, user_id long, event_type string, value double, props string"
    ).selectExpr("event_id", "timestamp_ntz '2024-01-01' AS ts", "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in QUERIES["graph.group_split"](spark, str(tmp_path)).collect()] == [(5, "excluded")]
