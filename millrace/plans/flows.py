"""Queries of dedup, components, conversions, layouts, gates and generators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import hashing as H
from ..functions import jsonx as J
from ..functions import text as X
from ..operators import aggregate as G
from ..operators import dedup as D
from ..operators import project as P
from ..operators import validate as V
from ..operators import window as W
from .catalog import Tables, query

c = F.col

# --- dedup and components ---------------------------------------------------------


@query("dedup.exact", "SELECT sha256(text) AS sha, min(id) AS id, count(*) AS n FROM cands GROUP BY 1")
def _(t: Tables):
    return D.exact(t.cands, c("text"), ["id"]).select("sha", "id", "n")


@query("dedup.annotation", "SELECT variant, k, turns, min(id) AS id FROM records GROUP BY 1, 2, 3")
def _(t: Tables):
    g = t.records.groupBy("variant", "k", "turns").agg(F.min(F.struct("id")).alias("m"))
    return g.select("variant", "k", "turns", "m.id")


@query("dedup.bytes_by_size", "SELECT strlen(text) AS size, min(id) AS id, count(*) AS n FROM cands GROUP BY strlen(text), sha256(text) HAVING count(*) > 1")
def _(t: Tables):
    g = t.cands.groupBy(F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha")).agg(F.min("id").alias("id"), F.count("*").alias("n"))
    return g.where("n > 1").select("size", "id", "n")


@query("dedup.phash", """WITH p AS (SELECT vec_id AS id, i, j, ('0x' || substr(sha256(vec_id || '|' || i), 2 * j + 1, 2))::INT AS g FROM embeddings, (SELECT unnest(range(0, 32)) AS i), (SELECT unnest(range(0, 32)) AS j)),
a AS (SELECT id, i, y, sum(g * cos(pi() / 32 * (j + 0.5) * y)) * sqrt(CASE y WHEN 0 THEN 1 ELSE 2 END / 32.0) AS s FROM p, (SELECT unnest(range(0, 8)) AS y) GROUP BY id, i, y),
b AS (SELECT id, x, y, sum(s * cos(pi() / 32 * (i + 0.5) * x)) * sqrt(CASE x WHEN 0 THEN 1 ELSE 2 END / 32.0) AS f FROM a, (SELECT unnest(range(0, 8)) AS x) GROUP BY id, x, y),
m AS (SELECT id, median(f) FILTER (WHERE x + y > 0) AS mid FROM b GROUP BY id)
SELECT id, string_agg(CASE WHEN f > mid THEN '1' ELSE '0' END, '' ORDER BY x, y) AS v FROM b JOIN m USING (id) GROUP BY id""")
def _(t: Tables):
    """Images of 32 x 32 grey pixels, a row of which is the hash of the image's id and the row."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.unhex(F.sha2(F.concat_ws("|", c("vec_id").cast("string"), i.cast("string")), 256)))
    pixels = F.aggregate(rows, F.lit(b""), lambda s, x: F.concat(s, x))
    return t.embeddings.select(c("vec_id").alias("id"), D.perceptual_hash(pixels).alias("v"))


@query("dedup.sign_hash", "SELECT vec_id AS id, array_to_string(list_transform(embedding::DOUBLE[], lambda v: CASE WHEN v > list_median(embedding::DOUBLE[]) THEN '1' ELSE '0' END), '') AS v FROM embeddings")
def _(t: Tables):
    return t.embeddings.select(c("vec_id").alias("id"), D.sign_hash(c("embedding").cast("array<double>")).alias("v"))


@query("dedup.near_confirm")
def _(t: Tables):
    """Vectors whose whole hash agrees, clustered greedily within a difference of 0.5; a bucket is one hash."""
    e = t.embeddings.select(c("vec_id").alias("id"), c("embedding").cast("array<double>").alias("v"))
    head = e.withColumn("bucket", D.sign_hash(c("v")))
    return D.greedy_clusters(head, "bucket", "id", "v", 0.5)


@query("dedup.text_pool", "SELECT min(id) AS id, x AS clean FROM (SELECT id, regexp_replace(category || ' ' || platform || '@x.org', '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '<EMAIL>', 'g') AS x FROM cands) GROUP BY x")
def _(t: Tables):
    return D.text_pool(t.cands, X.mask_email(X.required_text(F.concat(F.lit(" "), "category", F.lit(" "), "platform", F.lit("@x.org ")))), "id")


@query("graph.components", "SELECT id AS node, min(id) OVER (PARTITION BY id // 35) AS label FROM records")
def _(t: Tables):
    """Rows of one of seven share ``a``, and every fifth of those share ``b``: blocks of 35 ids."""
    n = t.records.select("id", F.floor(c("id") / 7).alias("a"), F.when(c("id") % 7 == 0, F.floor(c("id") / 35)).alias("b"))
    return D.key_components(n, "id", ["a", "b"])


@query("graph.group_split", "SELECT k, CASE WHEN count(DISTINCT split) > 2 THEN 'excluded' ELSE min(split) END AS split FROM records GROUP BY k")
def _(t: Tables):
    g = t.records.groupBy("k").agg(F.countDistinct("split").alias("d"), F.min("split").alias("s"))
    return D.assign_groups(g, "k", c("d") > 2, c("s"))


@query("graph.group_split.fold")
def _(t: Tables):
    """Groups of a leakage key with the hashes they hold, folded into splits; the key has at most a hundred values."""
    g = t.records.groupBy("k").agg(F.count("*").alias("n"), F.collect_set(F.floor(c("k") / 3) * 10 + c("k") % 2).alias("hashes")).collect()
    rows = W.fold_groups([(r.k, r.n, sorted(r.hashes), (r.k or 0) % 10 == 0) for r in g], "episode-split")
    return t.spark.createDataFrame(rows, "k long, split string")


@query("graph.group_assign", "SELECT episode, CASE WHEN max((k > 97)::INT) = 1 THEN 'excluded' ELSE min(split) END AS split FROM records GROUP BY 1")
def _(t: Tables):
    g = t.records.groupBy("episode").agg(F.bool_or(c("k") > 97).alias("conflict"), F.min("split").alias("s"))
    return D.assign_groups(g, "episode", c("conflict"), c("s"))


# --- conversions ------------------------------------------------------------------


@query("conv.single_step", "SELECT id, pos, CASE WHEN kind = 'action' THEN 'drag' ELSE 'look' END AS kind, x AS x2, coalesce(lag(x) OVER (PARTITION BY id ORDER BY pos), 500) AS x1 FROM steps")
def _(t: Tables):
    """Atomic positions into drags from the previous position."""
    prev = F.coalesce(F.lag("x").over(Window.partitionBy("id").orderBy("pos")), F.lit(500).cast("long"))
    return t.steps.select("id", "pos", F.when(c("kind") == "action", "drag").otherwise("look").alias("kind"), c("x").alias("x2"), prev.alias("x1"))


@query("conv.trace_pair", "SELECT id, pos, CASE WHEN id % 2 = 0 THEN x ELSE y END AS atomic, CASE WHEN id % 2 = 0 THEN y ELSE x END AS single FROM steps WHERE kind = 'action'")
def _(t: Tables):
    even = c("id") % 2 == 0
    return t.steps.where("kind = 'action'").select("id", "pos", F.when(even, c("x")).otherwise(c("y")).alias("atomic"), F.when(even, c("y")).otherwise(c("x")).alias("single"))


@query("conv.rotation", "SELECT id, count(*) AS moves, arg_max(x, pos) AS x, round(arg_max(x, pos) * 0.36 % 360, 6)::DOUBLE AS degrees FROM steps WHERE kind = 'action' GROUP BY 1")
def _(t: Tables):
    """A drag's moves collapse into the last slider position and its angle."""
    g = t.steps.where("kind = 'action'").groupBy("id").agg(F.count("*").alias("moves"), F.max_by("x", "pos").alias("x"))
    return g.select("id", "moves", "x", F.round(c("x") * 0.36 % 360, 6).cast("double").alias("degrees"))


@query("conv.dataset", "SELECT id % 6 AS cell, count(*) AS n, arg_min(id * 100 + pos, sha256('4|' || id || '|' || pos)) AS first FROM steps WHERE kind = 'action' GROUP BY 1")
def _(t: Tables):
    rows = t.steps.where("kind = 'action'").withColumn("cell", c("id") % 6).withColumn("h", H.sha_text("4", c("id"), c("pos")))
    return rows.groupBy("cell").agg(F.count("*").alias("n"), F.min_by(c("id") * 100 + c("pos"), "h").alias("first"))


@query("conv.normalize_trajectory", "SELECT id, count(*) FILTER (WHERE kind = 'action') AS n, true AS ok FROM steps GROUP BY 1")
def _(t: Tables):
    """Actions as tool calls that parse back into themselves."""
    call = J.format_tool_call(F.lit("left_click"), F.array(c("x").cast("int"), c("y").cast("int")))
    acts = t.steps.withColumn("call", call).withColumn("back", J.parse_final_click(c("call")))
    same = (F.get("back", 0) == c("x")) & (F.get("back", 1) == c("y"))
    return acts.groupBy("id").agg(F.count_if(c("kind") == "action").alias("n"), F.bool_and(same).alias("ok"))


@query("conv.publish_pair", "SELECT view, count(*) AS n, CAST(sum(k) AS BIGINT) AS k FROM (SELECT k, unnest(['direct', 'terminate']) AS view FROM records WHERE split = 'train') GROUP BY 1")
def _(t: Tables):
    return P.per_track(t.records.where("split = 'train'"), ["direct", "terminate"]).groupBy(c("track").alias("view")).agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query("conv.parquet_audit", "SELECT 'blank' AS rule, count(*) FILTER (WHERE trim(text) = '') AS n_bad FROM steps UNION ALL SELECT 'role', count(*) FILTER (WHERE role NOT IN ('user', 'assistant')) FROM steps UNION ALL SELECT 'first', count(*) FROM (SELECT id FROM steps GROUP BY 1 HAVING arg_min(role, pos) <> 'user')")
def _(t: Tables):
    rows = V.gate(t.steps, [("blank", F.trim("text") == ""), ("role", ~c("role").isin("user", "assistant"))])
    first = t.steps.groupBy("id").agg(F.min_by("role", "pos").alias("r")).agg(F.lit("first").alias("rule"), F.count_if(c("r") != "user").alias("n_bad"))
    return rows.unionByName(first)


@query("conv.waypoints", """SELECT id, j, round(x1 + (px - x1) * j / 4.0 + (CAST(('0x' || substr(sha256('w|' || id || '|' || j), 1, 16))::UBIGINT % 21 AS BIGINT) - 10), 6)::DOUBLE AS x FROM boxes, (SELECT unnest([1, 2, 3]) AS j)""")
def _(t: Tables):
    """Points on the way to a target, each moved aside by a hash of its key."""
    rows = t.boxes.withColumn("j", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])))
    aside = (H.stable_int("w", c("id"), c("j")) % 21).cast("long") - 10
    return rows.select("id", "j", F.round(c("x1") + (c("px") - c("x1")) * c("j") / 4 + aside, 6).alias("x"))


@query("conv.target_point", "SELECT id, x1 + (x2 - x1) * (CAST(('0x' || substr(sha256('t|' || id), 1, 16))::UBIGINT % 1000 AS BIGINT) / 1000) AS x FROM boxes")
def _(t: Tables):
    share = (H.stable_int("t", c("id")) % 1000).cast("long") / 1000
    return t.boxes.select("id", (c("x1") + (c("x2") - c("x1")) * share).alias("x"))


@query("conv.expand_release", "SELECT id, variant, row_index, CASE variant WHEN 'view' THEN 1000 ELSE 5000 END + row_index AS seed FROM (SELECT id, variant, row_number() OVER (PARTITION BY variant ORDER BY id) - 1 AS row_index FROM records WHERE variant IN ('view', 'click'))")
def _(t: Tables):
    rows = t.records.where(c("variant").isin("view", "click")).select("id", "variant")
    return P.expand_release(rows, "variant", "id", {"view": 1000, "click": 5000})


@query("conv.teacher_record", "SELECT s.id, s.pos, r.value AS note FROM steps s LEFT JOIN records r ON r.id = s.id * 10 + s.pos WHERE kind = 'action'")
def _(t: Tables):
    notes = t.records.select(c("id").alias("key"), c("value").alias("note"))
    return t.steps.where("kind = 'action'").withColumn("key", c("id") * 10 + c("pos")).join(notes, "key", "left").select("id", "pos", "note")


# --- record layouts and running state ------------------------------------------------


def _layouts(t: Tables):
    flat = F.when(c("id") % 4 == 0, F.array("k"))
    return t.records.select("id", "episode", "k", flat.alias("actions"), F.when(c("id") % 4 == 1, F.array(F.struct("k", "turns"))).alias("steps"), F.when(c("id") % 4 == 2, c("k")).alias("action"))


@query("load.dispatch", "SELECT id, CASE id % 4 WHEN 0 THEN 'flat' WHEN 1 THEN 'typed' WHEN 2 THEN 'old' ELSE 'unknown' END AS layout FROM records")
def _(t: Tables):
    layout = F.when(c("actions").isNotNull(), "flat").when(c("steps").isNotNull(), "typed").when(c("action").isNotNull(), "old").otherwise("unknown")
    return _layouts(t).select("id", layout.alias("layout"))


@query("load.examples", "SELECT id, k FROM records WHERE id % 4 < 3 ORDER BY id LIMIT 500")
def _(t: Tables):
    rows = _layouts(t)
    each = rows.select("id", F.coalesce(F.get("actions", 0), F.get("steps", 0).k, "action").alias("k")).where("k IS NOT NULL")
    return each.orderBy("id").limit(500)


@query("load.layout.flat", "SELECT id, pos, array_to_string(list_slice(l, 1, i), ',') AS history FROM (SELECT id, pos, list(pos) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS i FROM steps)")
def _(t: Tables):
    seq = t.steps.groupBy("id").agg(F.array_sort(F.collect_list("pos")).alias("l"))
    return seq.select("id", "l", F.posexplode("l").alias("i", "pos")).select("id", "pos", F.array_join(F.slice("l", 1, c("i")), ",").alias("history"))


@query("load.layout.typed", "SELECT id, pos, count(*) FILTER (WHERE kind = 'observation') OVER w AS seen, count(*) FILTER (WHERE kind = 'action') OVER w AS done FROM steps WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def _(t: Tables):
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.steps.select("id", "pos", F.count_if(c("kind") == "observation").over(w).alias("seen"), F.count_if(c("kind") == "action").over(w).alias("done"))


@query("load.layout.old", "SELECT id, pos, x, y FROM steps WHERE kind = 'action'")
def _(t: Tables):
    return t.steps.where("kind = 'action'").select("id", "pos", "x", "y")


@query("load.group.ordered", "SELECT episode, k % 10 AS part, string_agg(k::VARCHAR, ',' ORDER BY id) AS v FROM records GROUP BY 1, 2 HAVING count(*) = count(DISTINCT turns)")
def _(t: Tables):
    """Short sequences out of all rows: an episode's rows by the last digit of k."""
    g = t.records.groupBy("episode", (c("k") % 10).alias("part")).agg(F.array_sort(F.collect_list(F.struct("id", "k"))).alias("s"), F.count("*").alias("n"), F.countDistinct("turns").alias("d"))
    return g.where("n = d").select("episode", "part", F.array_join(F.transform("s", lambda x: x.k), ",").alias("v"))


@query("load.group.examples", "SELECT id, pos, count(*) OVER w AS before FROM steps WHERE id IN (SELECT id FROM steps GROUP BY 1 HAVING count(DISTINCT role) = 2) WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def _(t: Tables):
    same = t.steps.groupBy("id").agg(F.countDistinct("role").alias("d")).where("d = 2").select("id")
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return t.steps.join(same, "id", "left_semi").select("id", "pos", F.size(F.collect_list("pos").over(w)).cast("long").alias("before"))


@query("load.group.contiguous", "SELECT variant, count(*) AS islands FROM (SELECT variant, lag(variant) OVER (ORDER BY id) AS p FROM records) WHERE p IS DISTINCT FROM variant GROUP BY 1")
def _(t: Tables):
    """Islands by an explicit line index: of a block of 100 lines by its key, and between blocks by their ends."""
    rows = t.records.withColumn("block", F.floor(c("id") / 100))
    own = rows.withColumn("p", F.lag("variant").over(Window.partitionBy("block").orderBy("id"))).where("p IS NOT NULL AND p <> variant").select("variant")
    ends = rows.groupBy("block").agg(F.min_by("variant", "id").alias("first"), F.max_by("variant", "id").alias("last"))
    after = ends.select((c("block") + 1).alias("block"), c("last").alias("prev"))
    starts = ends.join(after, "block", "left").where("prev IS NULL OR prev <> first").select(c("first").alias("variant"))
    return own.unionByName(starts).groupBy("variant").agg(F.count("*").alias("islands"))


@query("state.button", "SELECT id, coalesce(last_value(CASE variant WHEN 'view' THEN 'down' WHEN 'error' THEN 'up' END IGNORE NULLS) OVER (PARTITION BY episode ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'up') AS button FROM records")
def _(t: Tables):
    w = Window.partitionBy("episode").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    change = F.when(c("variant") == "view", "down").when(c("variant") == "error", "up")
    return t.records.select("id", F.coalesce(F.last(change, True).over(w), F.lit("up")).alias("button"))


@query("state.cursor", "SELECT id, last_value(CASE WHEN variant <> 'signup' THEN k END IGNORE NULLS) OVER (PARTITION BY episode ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x FROM records")
def _(t: Tables):
    w = Window.partitionBy("episode").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.records.select("id", F.last(F.when(c("variant") != "signup", c("k")), True).over(w).alias("x"))


# --- gates, generators, registries ------------------------------------------------------


@query("gate.training_manifest", "SELECT 'leak' AS rule, count(*) FILTER (WHERE variant = 'purchase' AND split = 'test') AS n_bad FROM records UNION ALL SELECT 'pairing', count(*) FROM (SELECT episode FROM records GROUP BY 1 HAVING count(*) FILTER (WHERE variant = 'view') <> count(*) FILTER (WHERE variant = 'click')) UNION ALL SELECT 'count', count(*) FROM (SELECT variant FROM records GROUP BY 1 HAVING count(*) <> 2000)")
def _(t: Tables):
    leak = V.gate(t.records, [("leak", (c("variant") == "purchase") & (c("split") == "test"))])
    pairs = t.records.groupBy("episode").agg((F.count_if(c("variant") == "view") != F.count_if(c("variant") == "click")).alias("bad")).agg(F.lit("pairing").alias("rule"), F.count_if("bad").alias("n_bad"))
    return leak.unionByName(pairs).unionByName(V.count_gate(t.records, "variant", 2000))


@query("gate.formal_manifest", "SELECT 'required' AS rule, count(*) FILTER (WHERE variant IS NULL OR split IS NULL) AS n_bad FROM records UNION ALL SELECT 'band', count(*) FILTER (WHERE k > 95) FROM records UNION ALL SELECT 'off_screen', count(*) FILTER (WHERE turns > 19) FROM records UNION ALL SELECT 'duplicate', count(*) FROM (SELECT id FROM records GROUP BY 1 HAVING count(*) > 1)")
def _(t: Tables):
    rows = V.gate(t.records, [("required", c("variant").isNull() | c("split").isNull()), ("band", c("k") > 95), ("off_screen", c("turns") > 19)])
    return rows.unionByName(V.unique_gate(t.records, ["id"]))


@query("gate.suite", "SELECT count(*) AS n, count(DISTINCT id) AS ids, count(DISTINCT variant) AS variants, count(*) = count(DISTINCT id) AND count(DISTINCT variant) = 5 AS frozen FROM records")
def _(t: Tables):
    g = t.records.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.countDistinct("variant").alias("variants"))
    return g.withColumn("frozen", (c("n") == c("ids")) & (c("variants") == 5))


@query("gen.positions")
def _(t: Tables):
    """Eight points a row, none nearer than 90 to another: seeded draws, a grid where draws fail."""

    def run(batches):
        for p in batches:
            out = []
            for i in p["id"]:
                rng, pts = np.random.default_rng(int(i)), []
                for _ in range(400):
                    if len(pts) == 8:
                        break
                    q = rng.uniform((40, 40), (1240, 680))
                    if all(np.hypot(*(q - o)) >= 90 for o in pts):
                        pts.append(q)
                grid = [np.array((120 + 150 * (j % 8), 200 + 200 * (j // 8))) for j in range(8)]
                pts = pts if len(pts) == 8 else grid
                out += [(i, j, float(x), float(y)) for j, (x, y) in enumerate(pts)]
            yield pd.DataFrame(out, columns=["id", "j", "x", "y"])

    return t.records.select("id").mapInPandas(run, "id long, j long, x double, y double")


@query("udf.action_types", "SELECT id, CASE WHEN k % 4 = 0 THEN 'no_coordinate' WHEN k % 4 = 1 THEN NULL WHEN k % 4 = 2 THEN 'unknown_kind' END AS reason FROM records")
def _(t: Tables):
    """Actions are structs; their invariants are rules with reasons."""
    kind = F.when(c("k") % 4 == 2, "fly").when(c("k") % 4 == 3, "wait").otherwise("click")
    a = t.records.select("id", F.struct(kind.alias("kind"), F.when(c("k") % 4 == 1, c("k")).alias("x")).alias("a"))
    rules = [("unknown_kind", ~c("a.kind").isin("click", "move", "wait")), ("no_coordinate", c("a.kind").isin("click", "move") & c("a.x").isNull())]
    return a.select("id", V.first_reason(rules).alias("reason"))


@query("udf.variant_catalog", "SELECT r.id, 'fam-' || substr(r.variant, 1, 1) AS family FROM records r")
def _(t: Tables):
    """The registry of variants is a small fixed table."""
    names = ("view", "click", "error", "signup", "purchase")
    reg = t.spark.createDataFrame([(n, f"fam-{n[0]}") for n in names], "variant string, family string")
    return t.records.join(F.broadcast(reg), "variant").select("id", "family")


@query("udf.teacher_protocol", "SELECT id, pos, length(text) AS note FROM steps WHERE kind = 'action'")
def _(t: Tables):
    """Annotations come as a table and are joined by key."""
    notes = t.conversations.select(c("conv_id").alias("id"), c("turn").alias("pos"), F.length("text").cast("long").alias("note"))
    return t.steps.where("kind = 'action'").select("id", "pos").join(notes, ["id", "pos"])


# --- end to end ----------------------------------------------------------------------


@query("flow.curate", "WITH k AS (SELECT id, platform, category, text, n, row_number() OVER (PARTITION BY text ORDER BY id) AS nth FROM cands WHERE n >= 100 AND NOT contains(text, '!!')), s AS (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY sha256('c|' || id), id) AS r FROM k WHERE nth = 1 AND id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) SELECT id, category, CASE WHEN r <= 5 THEN 'eval' ELSE 'train' END AS part FROM s")
def _(t: Tables):
    """Rules, exact dedup, held-out anti join and a seeded split in one flow."""
    good, _ = V.split_rejects(t.cands, [("short", c("n") < 100), ("shouting", c("text").contains("!!"))])
    first = W.first_by(good.withColumn("sha", F.sha2("text", 256)), ["sha"], ["id"])
    clean = first.join(t.labels.where("toxic = 1").select(c("doc_id").alias("id")), "id", "left_anti")
    held = W.first_by(clean.select("id", "category"), ["category"], [W.hash_order("c", "id"), "id"], 5).select("id", F.lit("eval").alias("part"))
    return clean.select("id", "category").join(held, "id", "left").select("id", "category", F.coalesce("part", F.lit("train")).alias("part"))


@query("flow.evaluate", "SELECT variant, count(*) AS n, round(avg(success::INT), 6) AS rate, round(median(value), 6) AS mid FROM records WHERE episode IN (SELECT episode FROM records WHERE split = 'train') GROUP BY ROLLUP (variant)")
def _(t: Tables):
    kept = t.records.join(t.records.where("split = 'train'").select("episode"), "episode", "left_semi")
    return kept.rollup("variant").agg(F.count("*").alias("n"), F.round(F.avg(c("success").cast("int")), 6).alias("rate"), F.round(F.median("value"), 6).alias("mid"))


@query("flow.loops", "SELECT episode, longest >= 4 AS stuck FROM (SELECT episode, max(n) AS longest FROM (SELECT episode, isle, count(*) AS n FROM (SELECT episode, sum(new) OVER (PARTITION BY episode ORDER BY id) AS isle FROM (SELECT episode, id, (variant IS DISTINCT FROM lag(variant) OVER (PARTITION BY episode ORDER BY id))::INT AS new FROM records)) GROUP BY 1, 2) GROUP BY 1)")
def _(t: Tables):
    return G.max_runs(t.records, "episode", "id", "variant").select("episode", (c("longest") >= 4).alias("stuck"))


@query("arr.max_run", "SELECT id, CASE WHEN k % 2 = 0 THEN 3 ELSE 2 END AS v FROM records")
def _(t: Tables):
    a = F.array(c("k"), c("k"), F.when(c("k") % 2 == 0, c("k")).otherwise(-1), F.lit(-2).cast("long"))
    return t.records.select("id", A.max_run(a).alias("v"))
