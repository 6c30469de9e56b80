"""Traces: many to a file, each judged by all of its rows."""

import duckdb
import pytest
from compare import same

from millrace.plans import files
from millrace.plans.everything import ORACLES, QUERIES

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
KINDS = ("view", "click", "error", "signup", "purchase")


@pytest.fixture
def scan(spark, tmp_path, monkeypatch):
    """Of (episode, variant) rows: the judged traces agree with the SQL; the files that held them."""

    def run(rows):
        monkeypatch.setattr(files, "shared_folder", lambda _: f"{tmp_path}/shared")
        spark.createDataFrame([(i, None, e, v, 1.0, "{}") for i, (e, v) in enumerate(rows)], EVENTS).repartition(8).write.parquet(f"{tmp_path}/events.parquet")
        df = QUERIES["scan.traces"](spark, str(tmp_path))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        same(df, con, ORACLES["scan.traces"])
        return {r.episode: (r.n, r.reason) for r in df.collect()}, list((tmp_path / "shared").rglob("part-*"))

    return run


def test_many_traces_are_few_files(scan):
    """Ids far apart, so that no range of ids holds many."""
    got, held = scan([(e * 10**9, KINDS[0]) for e in range(300) for _ in range(2)])
    assert got == {e * 10**9: (2, "short") for e in range(300)}
    assert len(held) <= 8


def test_rows_of_a_trace_in_all_parts_of_the_table(scan):
    rows = [(1, KINDS[i % 5]) for i in range(60)] + [(-2, KINDS[i % 4]) for i in range(60)] + [(3, KINDS[i % 5]) for i in range(59)]
    rows += [(None, KINDS[i % 5]) for i in range(60)] + [(4, KINDS[i % 4] if i % 5 else None) for i in range(61)]
    got, _ = scan(rows)
    assert got == {1: (60, None), -2: (60, "variants"), 3: (59, "short"), None: (60, None), 4: (61, "variants")}


def test_no_traces(scan):
    assert scan([])[0] == {}


def test_a_trace_with_most_rows_is_many_tasks_work(spark, scan):
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        got, held = scan([(7, KINDS[i % 5]) for i in range(20000)] + [(e, KINDS[0]) for e in range(100, 120)])
    finally:
        for k in sizes:
            spark.conf.unset(k)
    assert got[7] == (20000, None) and len(got) == 21
    assert sum('"episode":7,' in p.read_text() for p in held) > 3
