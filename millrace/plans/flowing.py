"""Queries of streams; the SQL is their batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import window as W
from ..streaming import streams as S
from .catalog import Tables, query

c = F.col


def _stream(t: Tables):
    rows = S.events(t.spark, f"{t.where}/events.parquet")
    return rows.select(c("event_id").alias("id"), c("user_id").alias("episode"), c("event_type").alias("variant"), "value", c("ts").cast("timestamp").alias("ts"))


@query("stream.ordered_map", "SELECT id, round(value * 2, 6) AS v FROM records")
def _(t: Tables):
    """Tasks run in any order; the result is ordered by its key."""
    return t.records.select("id", F.round(c("value") * 2, 6).alias("v")).orderBy("id")


@query("stream.iter_windows", "SELECT id, stop FROM (SELECT id, unnest(range(least(3, turns), turns + 1)) AS stop FROM records)")
def _(t: Tables):
    rows = _stream(t).withColumn("turns", c("id") % 20 + 1)
    return S.run(W.sliding(rows, "id", "turns").select("id", "stop"))


@query("stream.trace_session", "SELECT id, episode, variant FROM records")
def _(t: Tables):
    return S.run(_stream(t).select("id", "episode", "variant"))


_RUNS = """(SELECT episode, max(n) AS longest FROM (SELECT episode, isle, count(*) AS n FROM (SELECT episode, sum(new) OVER (PARTITION BY episode ORDER BY id) AS isle FROM (
  SELECT episode, id, (variant IS DISTINCT FROM lag(variant) OVER (PARTITION BY episode ORDER BY id))::INT AS new FROM records)) GROUP BY 1, 2) GROUP BY 1)"""
_SWINGS = """(SELECT episode, count(*) AS steps, count(*) FILTER (WHERE variant = b AND a = d AND variant <> a) AS swings FROM (SELECT episode, variant, lag(variant, 1) OVER w AS a, lag(variant, 2) OVER w AS b, lag(variant, 3) OVER w AS d FROM records WINDOW w AS (PARTITION BY episode ORDER BY id)) GROUP BY 1)"""


@query("stream.progress_state", f"SELECT episode, steps, longest, swings, steps > 70 AS over FROM {_RUNS} JOIN {_SWINGS} USING (episode)")
def _(t: Tables):
    return S.run(S.progress(_stream(t), 70), "update", "episode")


@query("stream.no_think_state", f"SELECT episode, steps, longest FROM {_RUNS.replace('FROM records', 'FROM records WHERE value < 100')} JOIN {_SWINGS.replace('FROM records', 'FROM records WHERE value < 100')} USING (episode)")
def _(t: Tables):
    return S.run(S.progress(_stream(t).where("value < 100"), 70), "update", "episode").select("episode", "steps", "longest")


@query("stream.static_state", """SELECT episode, least(3, clicks) AS clicks, CASE WHEN clicks >= 3 THEN 'limit' WHEN e IS NOT NULL THEN 'ended' ELSE 'open' END AS status FROM (
  SELECT episode, e, count(*) FILTER (WHERE variant = 'click' AND (e IS NULL OR id < e)) AS clicks FROM (SELECT *, min(id) FILTER (WHERE variant = 'error') OVER (PARTITION BY episode) AS e FROM records) GROUP BY 1, 2)""")
def _(t: Tables):
    return S.run(S.machine(_stream(t), "click", "error", 3), "update", "episode")


@query("stream.reward_map", "SELECT id, CASE variant WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 0.5 WHEN 'view' THEN 0.0 END::DOUBLE AS reward FROM records")
def _(t: Tables):
    table = t.spark.createDataFrame([("purchase", 1.0), ("signup", 0.5), ("view", 0.0)], "variant string, reward double")
    return S.run(_stream(t).join(F.broadcast(table), "variant", "left").select("id", "reward"))


@query("stream.resume", "SELECT id FROM records WHERE NOT (success AND k > 50)")
def _(t: Tables):
    done = t.records.where("success AND k > 50").select("id")
    return S.run(_stream(t).select("id").join(done, "id", "left_anti"))


@query("stream.materialize_steps", "SELECT id, pos, round(1.0 / turns, 9)::DOUBLE AS weight FROM (SELECT id, turns, unnest(range(0, turns)) AS pos FROM records)")
def _(t: Tables):
    turns = c("id") % 20 + 1
    steps = F.posexplode(F.sequence(F.lit(1).cast("long"), turns)).alias("pos", "nth")
    return S.run(_stream(t).select("id", turns.alias("turns"), steps).select("id", c("pos").cast("long").alias("pos"), F.round(1 / c("turns"), 9).alias("weight")))


@query("stream.session.late", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, variant, count(*) AS n, round(sum(value), 4) AS v FROM records GROUP BY 1, 2")
def _(t: Tables):
    """Tumbling days under a watermark; complete mode, so late rows count."""
    g = _stream(t).withWatermark("ts", "2 hours").groupBy(F.window("ts", "1 day"), "variant").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return S.run(g.select(c("window.start").cast("timestamp_ntz").alias("start"), "variant", "n", "v"), "complete")


@query("stream.window.sliding", "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS start FROM records) GROUP BY 1")
def _(t: Tables):
    g = _stream(t).withWatermark("ts", "2 hours").groupBy(F.window("ts", "1 day", "12 hours")).agg(F.count("*").alias("n"))
    return S.run(g.select(c("window.start").cast("timestamp_ntz").alias("start"), "n"), "complete")


@query("stream.window.session", """SELECT episode, min(ts) AS start, count(*) AS n FROM (SELECT episode, ts, sum(new) OVER (PARTITION BY episode ORDER BY ts, id) AS s FROM (
  SELECT id, episode, ts, coalesce(ts - lag(ts) OVER (PARTITION BY episode ORDER BY ts, id) >= INTERVAL 12 HOUR, true)::INT AS new FROM records)) GROUP BY episode, s""")
def _(t: Tables):
    g = _stream(t).withWatermark("ts", "2 hours").groupBy("episode", F.session_window("ts", "12 hours")).agg(F.count("*").alias("n"))
    return S.run(g.select("episode", c("session_window.start").cast("timestamp_ntz").alias("start"), "n"), "complete")


@query("stream.dedup", "SELECT id, variant, value FROM records")
def _(t: Tables):
    """A stream that brings every event twice; one row of each id is kept, whichever comes first."""
    rows = _stream(t).select("id", "variant", "value")
    return S.run(rows.unionByName(rows).dropDuplicates(["id"]))
