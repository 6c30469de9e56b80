"""Queries of text, JSON, hash, geometry and array functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import geometry as G
from ..functions import hashing as H
from ..functions import jsonx as J
from ..functions import text as X
from .catalog import Tables, query

c = F.col

# --- text ---------------------------------------------------------------------


@query("str.normalize_ws", "SELECT id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS v FROM cands")
def _(t: Tables):
    return t.cands.select("id", X.normalize_ws(c("text")).alias("v"))


@query("str.required_text", "SELECT id, CASE WHEN n % 3 = 0 THEN NULL ELSE platform END AS v FROM cands")
def _(t: Tables):
    raw = F.when(c("n") % 3 == 0, "  \t ").otherwise(F.concat(F.lit("  "), "platform", F.lit("\n")))
    return t.cands.select("id", X.required_text(raw).alias("v"))


@query("str.mask_email", "SELECT id, regexp_replace(text, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b', '<EMAIL>', 'g') AS v FROM cands")
def _(t: Tables):
    return t.cands.select("id", X.mask_email(c("text")).alias("v"))


@query("str.category_default", "SELECT id, CASE WHEN category = 'de' THEN '__unlabeled__' ELSE category END AS v FROM cands")
def _(t: Tables):
    return t.cands.select("id", X.category_default(F.when(c("category") == "de", " ").otherwise(c("category"))).alias("v"))


@query("str.prefix_category", "SELECT id, CASE variant WHEN 'view' THEN 'functional' WHEN 'click' THEN 'direct' END AS v FROM records")
def _(t: Tables):
    kind = F.when(c("variant") == "view", "functional").when(c("variant") == "click", "direct_icon").otherwise("other")
    return t.records.select("id", X.prefix_category(kind).alias("v"))


@query("str.extract_label", "SELECT id, platform AS v FROM cands WHERE n % 2 = 0 UNION ALL SELECT id, category FROM cands WHERE n % 2 = 1")
def _(t: Tables):
    text = F.when(c("n") % 2 == 0, F.concat(F.lit("click the one labeled  '"), "platform", F.lit("' now"))).otherwise(F.concat(F.lit('Find the icon that displays "'), "category", F.lit('"')))
    return t.cands.select("id", X.extract_label(text).alias("v"))


@query("str.split_think", "SELECT id, CASE WHEN n % 2 = 0 THEN category END AS thought, CASE WHEN n % 2 = 0 THEN platform ELSE '<think>' || platform END AS rest FROM cands")
def _(t: Tables):
    text = F.when(c("n") % 2 == 0, F.concat(F.lit("<think> "), "category", F.lit(" </think>\n"), "platform")).otherwise(F.concat(F.lit("<think>"), "platform"))
    thought, rest = X.split_think(text)
    return t.cands.select("id", thought.alias("thought"), rest.alias("rest"))


@query("str.render_think", "SELECT id, '<think>' || category || '</think>' || chr(10) || '{\"a\":\"' || platform || '\"}' AS v FROM cands")
def _(t: Tables):
    return t.cands.select("id", X.render_think(c("category"), F.to_json(F.struct(c("platform").alias("a")))).alias("v"))


@query("str.id_split", "SELECT id, CASE WHEN k % 5 = 0 THEN 'unknown' ELSE split END AS v FROM records")
def _(t: Tables):
    return t.records.select("id", X.id_split(F.concat_ws("_", F.when(c("k") % 5 == 0, "other").otherwise("set"), "split", c("id").cast("string")), "set_").alias("v"))


@query("str.batch_key", "SELECT id, 'ep_' || episode AS v FROM records")
def _(t: Tables):
    return t.records.select("id", X.batch_key(F.concat_ws("_", F.lit("ep"), "episode", "turns", "id")).alias("v"))


# --- JSON ---------------------------------------------------------------------


@query("json.format_tool_call", """SELECT id, '<tool_call>' || chr(10) || '{"name":"computer_use","arguments":{"action":"left_click","coordinate":[' || k || ',' || turns || ']}}' || chr(10) || '</tool_call>' AS v FROM records""")
def _(t: Tables):
    return t.records.select("id", J.format_tool_call(F.lit("left_click"), F.array("k", "turns")).alias("v"))


def _responses(t: Tables):
    good = J.format_tool_call(F.lit("left_click"), F.array("k", "turns"))
    extra = F.concat(good, F.lit(" ok"))
    other = J.format_tool_call(F.lit("terminate"), status=F.lit("success"))
    bad = F.regexp_replace(good, "left_click", 'left_click","speed":"1')  # a key too many
    pick = F.when(c("id") % 4 == 0, good).when(c("id") % 4 == 1, extra).when(c("id") % 4 == 2, other).otherwise(bad)
    return t.records.select("id", "k", "turns", pick.alias("r"))


_PARSED = """SELECT id, CASE id % 4 WHEN 0 THEN 'left_click' WHEN 2 THEN 'terminate' END AS action, CASE WHEN id % 4 = 0 THEN k END AS x, CASE WHEN id % 4 = 0 THEN turns END AS y,
  CASE WHEN id % 4 = 2 THEN 'success' END AS status FROM records"""


@query("json.parse_tool_call", _PARSED)
def _(t: Tables):
    a = _responses(t).select("id", J.parse_tool_call(c("r")).alias("a"))
    return a.select("id", "a.action", F.get("a.coordinate", 0).cast("long").alias("x"), F.get("a.coordinate", 1).cast("long").alias("y"), "a.status")


@query("json.parse_direct", "SELECT id, CASE id % 4 WHEN 0 THEN 'left_click' WHEN 2 THEN 'terminate' END AS action FROM records")
def _(t: Tables):
    return _responses(t).select("id", J.parse_tool_call(F.concat(F.lit("\n"), c("r"), F.lit("  "))).action.alias("action"))


@query("json.parse_response.final", "SELECT id, CASE WHEN id % 4 = 0 THEN k END AS x, CASE WHEN id % 4 = 0 THEN turns END AS y FROM records")
def _(t: Tables):
    p = _responses(t).select("id", J.parse_final_click(c("r")).alias("p"))
    return p.select("id", F.get("p", 0).cast("long").alias("x"), F.get("p", 1).cast("long").alias("y"))


@query("json.parse_strict_action", """SELECT id, CASE WHEN id % 4 = 0 THEN k::DOUBLE END AS x, CASE id % 4 WHEN 1 THEN 'a key is there twice' WHEN 2 THEN 'NaN' WHEN 3 THEN 'not an integer' END AS reason FROM records""")
def _(t: Tables):
    head = F.concat(F.lit('{"kind":"move","x":'), c("k").cast("string"))
    text = F.when(c("id") % 4 == 0, F.concat(head, F.lit(',"y":2}'))).when(c("id") % 4 == 1, F.concat(head, F.lit(',"y":2,"x":3}'))).when(c("id") % 4 == 2, F.concat(head, F.lit(',"y":NaN}'))).otherwise(F.concat(head, F.lit(',"y":2.0}')))
    a = J.parse_strict_action(text)
    return t.records.withColumn("a", a).select("id", c("a.x").alias("x"), c("a.reason").alias("reason"))


@query("json.parse_think_payload", "SELECT id, CASE WHEN id % 3 < 2 THEN CAST(k AS VARCHAR) END AS v FROM records")
def _(t: Tables):
    body = F.concat(F.lit('{"think":'), c("k").cast("string"), F.lit("}"))
    text = F.when(c("id") % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).when(c("id") % 3 == 1, body).otherwise(F.concat(F.lit('{"think":'), c("k").cast("string")))
    return t.records.select("id", F.get_json_object(J.repair_object(text), "$.think").alias("v"))


@query("json.parse_actions", "SELECT id, 'move ' || k || ' ' || turns || ';click ' || turns || ' ' || k || ';click 7 8' AS v FROM records")
def _(t: Tables):
    text = F.concat(F.lit('I do {"kind": "move", "x": '), c("k").cast("string"), F.lit(', "y": '), c("turns").cast("string"), F.lit("} and click("), c("turns").cast("string"), F.lit(", "), c("k").cast("string"), F.lit(") then CLICK <7> <8>."))
    return t.records.select("id", F.array_join(J.parse_actions(text), ";").alias("v"))


@query("json.equal_exact", "SELECT id, id % 3 = 0 AS v FROM records")
def _(t: Tables):
    a = F.concat(F.lit('{"a":['), c("k").cast("string"), F.lit('],"b":1}'))
    b = F.when(c("id") % 3 == 0, F.concat(F.lit('{"b":1,"a":['), c("k").cast("string"), F.lit("]}"))).when(c("id") % 3 == 1, F.regexp_replace(a, r'"b":1', '"b":1.0')).otherwise(F.regexp_replace(a, r'"b":1', '"b":true'))
    return t.records.select("id", J.equal_exact(a, b).alias("v"))


# --- hashes -------------------------------------------------------------------


@query("hash.fingerprint", """SELECT id, sha256('{"action_index":' || turns || ',"instruction":"' || variant || '","record":' || id || '}') AS v FROM records""")
def _(t: Tables):
    row = F.struct(c("id").alias("record"), c("variant").alias("instruction"), c("turns").alias("action_index"))
    return t.records.select("id", F.sha2(J.canonical_row(row), 256).alias("v"))


@query("hash.stable_int", "SELECT id, CAST(('0x' || substr(sha256('7|' || id), 1, 16))::UBIGINT % 1000 AS BIGINT) AS v FROM records")
def _(t: Tables):
    return t.records.select("id", (H.stable_int("7", c("id")) % 1000).cast("long").alias("v"))


@query("hash.selection_id", "SELECT id, 'sel_' || split || '_' || substr(sha256(variant), 1, 12) || '_' || substr(sha256('7|' || split || '|' || id), 1, 12) AS v FROM records")
def _(t: Tables):
    return t.records.select("id", H.selection_id("sel", c("split"), F.sha2("variant", 256), H.sha_text("7", c("split"), c("id"))).alias("v"))


@query("rng.lcg", """WITH RECURSIVE s AS (SELECT id, 0 AS i, id % 4294967296 AS x FROM records UNION ALL SELECT id, i + 1, (x * 1664525 + 1013904223) % 4294967296 FROM s WHERE i < 5)
SELECT id, round(sum(x / 4294967296), 9) AS v FROM s WHERE i > 0 GROUP BY id""")
def _(t: Tables):
    return t.records.select("id", F.round(F.aggregate(H.lcg(c("id"), 5), F.lit(0.0), lambda s, x: s + x), 9).alias("v"))


# --- rounding and geometry ------------------------------------------------------


@query("math.half_up", "SELECT id, round((value / 4)::DECIMAL(30, 10), 1)::DOUBLE AS v FROM records")
def _(t: Tables):
    return t.records.select("id", G.half_up(c("value") / 4, 1).alias("v"))


@query("math.round_coord", "SELECT id, CASE WHEN id % 8 = 0 THEN CAST(id // 8 AS VARCHAR) ELSE CAST(id / 8 AS VARCHAR) END AS v FROM records")
def _(t: Tables):
    return t.records.select("id", G.round_coord(c("id") / 8).alias("v"))


@query("math.js_round", "SELECT id, CAST(floor(value - 25 + 0.5) AS BIGINT) AS v FROM records")
def _(t: Tables):
    return t.records.select("id", G.js_round(c("value") - 25).cast("long").alias("v"))


@query("math.wrap_deg", "SELECT id, ((id * 37 - 5000 + 180) % 360 + 360) % 360 - 180.0::DOUBLE AS v FROM records")
def _(t: Tables):
    return t.records.select("id", G.wrap_deg((c("id") * 37 - 5000).cast("double")).alias("v"))


@query("geo.quantize", "SELECT id, CAST(least(1000, greatest(0, floor(px * 1000 / w + 0.5))) AS BIGINT) AS v FROM boxes")
def _(t: Tables):
    return t.boxes.select("id", G.quantize(c("px"), c("w")).alias("v"))


@query("geo.pixel_to_model", "SELECT id, CAST(least(1000, greatest(0, round_even(py / h * 1000, 0))) AS BIGINT) AS v FROM boxes")
def _(t: Tables):
    return t.boxes.select("id", G.pixel_to_model(c("py"), c("h")).alias("v"))


@query("geo.model_to_pixel", "SELECT id, CASE WHEN px <= 1000 THEN px / 1000.0::DOUBLE * 1280 END AS v FROM boxes")
def _(t: Tables):
    return t.boxes.select("id", G.model_to_pixel(c("px"), 1280.0).alias("v"))


@query("geo.relative_bin", "SELECT id, least(least(1000, k * 12)::DOUBLE / 1000 * 720, 719) AS v FROM boxes")
def _(t: Tables):
    return t.boxes.select("id", G.relative_bin(c("k") * 12, 720).alias("v"))


@query("geo.qwen25", "SELECT id, CAST(round(((k * 10) * 1288.0 / 1000)::DECIMAL(30, 10), 0) AS BIGINT) AS v FROM boxes")
def _(t: Tables):
    return t.boxes.select("id", G.to_resized(c("k") * 10, F.lit(1288.0)).alias("v"))


@query("geo.model_bbox", "SELECT id, x1 * 1000 / w AS a, y1 * 1000 / h AS b, x2 * 1000 / w AS c, y2 * 1000 / h AS d FROM boxes")
def _(t: Tables):
    v = G.model_bbox(*[c(n) for n in ("x1", "y1", "x2", "y2", "w", "h")])
    return t.boxes.select("id", *[x.alias(n) for x, n in zip(v, "abcd")])


@query("geo.inside_image", "SELECT id, x1 >= 0 AND y1 >= 0 AND x2 <= w AND y2 <= h AND x1 < x2 AND y1 < y2 AS v FROM boxes")
def _(t: Tables):
    return t.boxes.select("id", G.inside_image(*[c(n) for n in ("x1", "y1", "x2", "y2", "w", "h")]).alias("v"))


@query("geo.bbox_contains", "SELECT id, px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2 AS v FROM boxes")
def _(t: Tables):
    return t.boxes.select("id", G.bbox_contains(*[c(n) for n in ("px", "py", "x1", "y1", "x2", "y2")]).alias("v"))


@query("geo.distance_bbox", "SELECT id, round(sqrt(power(greatest(x1 - px, 0, px - x2), 2) + power(greatest(y1 - py, 0, py - y2), 2)), 6) AS v FROM boxes")
def _(t: Tables):
    return t.boxes.select("id", F.round(G.distance_bbox(*[c(n) for n in ("px", "py", "x1", "y1", "x2", "y2")]), 6).alias("v"))


@query("geo.point_in_polygon", "SELECT id, py BETWEEN y1 AND 720 AND x1 * (720 - y1) + (py - y1) * (1280 - x1) >= px * (720 - y1) AND px >= x1 AS v FROM boxes")
def _(t: Tables):
    """Inside the triangle (x1, y1), (1280, 720), (x1, 720)."""
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    tri = F.array(pt(c("x1"), c("y1")), pt(c("w"), c("h")), pt(c("x1"), c("h")))
    return t.boxes.select("id", G.point_in_polygon(c("px"), c("py"), tri).alias("v"))


@query("geo.score", "SELECT id, CASE WHEN id % 7 = 0 OR px > 1000 THEN 'wrong_format' WHEN px * w / 1000 BETWEEN x1 AND x2 AND py * h / 1000 BETWEEN y1 AND y2 THEN 'correct' ELSE 'wrong' END AS v FROM boxes")
def _(t: Tables):
    return t.boxes.select("id", G.score(F.when(c("id") % 7 != 0, c("px")), *[c(n) for n in ("py", "w", "h", "x1", "y1", "x2", "y2")]).alias("v"))


@query("geo.bucket.aspect", "SELECT id, CASE WHEN (x2 - x1 + 1) / (y2 - y1 + 1) < 0.8 THEN 'portrait' WHEN (x2 - x1 + 1) / (y2 - y1 + 1) <= 1.25 THEN 'square' WHEN (x2 - x1 + 1) / (y2 - y1 + 1) <= 1.8 THEN 'landscape' ELSE 'wide' END AS v FROM boxes")
def _(t: Tables):
    return t.boxes.select("id", G.aspect_bucket(c("x2") - c("x1") + 1, c("y2") - c("y1") + 1).alias("v"))


@query("geo.bucket.size", "SELECT id, CASE WHEN px * py * 4 < 307200 THEN 'small' WHEN px * py * 4 < 921600 THEN 'medium' WHEN px * py * 4 < 2073600 THEN 'large' ELSE 'xlarge' END AS v FROM boxes")
def _(t: Tables):
    return t.boxes.select("id", G.size_bucket(c("px") * 2, c("py") * 2).alias("v"))


@query("geo.bucket.area", "SELECT id, CASE WHEN a < 0.001 THEN 'tiny' WHEN a < 0.01 THEN 'small' WHEN a < 0.05 THEN 'medium' ELSE 'large' END AS v FROM (SELECT id, (x2 - x1) * (y2 - y1) / (w * h) AS a FROM boxes)")
def _(t: Tables):
    return t.boxes.select("id", G.area_bucket(*[c(n) for n in ("x1", "y1", "x2", "y2", "w", "h")]).alias("v"))


@query("geo.projection_alpha", "SELECT id, CASE WHEN e > 0 THEN round(u / e, 6) END AS v FROM (SELECT id, (x2 - x1) * (px - x1) + (y2 - y1) * (py - y1) AS u, (px - x1) * (px - x1) + (py - y1) * (py - y1) AS e FROM boxes)")
def _(t: Tables):
    return t.boxes.select("id", F.round(G.projection_alpha(c("x2") - c("x1"), c("y2") - c("y1"), c("px") - c("x1"), c("py") - c("y1")), 6).alias("v"))


@query(
    "geo.smart_resize",
    """WITH s AS (SELECT id, px + 10 AS w, py + 10 AS h, greatest(28, round_even((px + 10) / 28, 0) * 28) AS rw, greatest(28, round_even((py + 10) / 28, 0) * 28) AS rh FROM boxes)
SELECT id, CAST(CASE WHEN rw * rh > 401408 THEN greatest(28, floor(w / sqrt(w * h / 401408) / 28) * 28) WHEN rw * rh < 50176 THEN greatest(28, ceil(w * sqrt(50176 / (w * h)) / 28) * 28) ELSE rw END AS BIGINT) AS a,
  CAST(CASE WHEN rw * rh > 401408 THEN greatest(28, floor(h / sqrt(w * h / 401408) / 28) * 28) WHEN rw * rh < 50176 THEN greatest(28, ceil(h * sqrt(50176 / (w * h)) / 28) * 28) ELSE rh END AS BIGINT) AS b FROM s""",
)
def _(t: Tables):
    """No size of these images needs a further step."""
    a, b = G.smart_resize(c("px") + 10, c("py") + 10, 28, 50176, 401408)
    return t.boxes.select("id", a.alias("a"), b.alias("b"))


@query(
    "geo.score_sequence",
    """SELECT id, CASE id % 8 WHEN 0 THEN hit WHEN 1 THEN 'wrong_format' WHEN 2 THEN 'wrong_action' WHEN 3 THEN 'wrong_action' WHEN 4 THEN 'wrong_action' WHEN 5 THEN 'wrong_format' WHEN 6 THEN 'wrong_format' ELSE 'wrong_action' END AS v
FROM (SELECT id, CASE WHEN k * 10 * w / 1000 BETWEEN x1 AND x2 + 200 AND 500 * h / 1000 BETWEEN y1 AND y2 + 200 THEN 'correct' ELSE 'wrong' END AS hit FROM boxes)""",
)
def _(t: Tables):
    """Good sequences, and each way to break one."""
    act = lambda a, xy=None, s=None: F.struct(F.lit(a).alias("action"), (F.lit(None).cast("array<int>") if xy is None else xy).alias("coordinate"), F.lit(s).cast("string").alias("status"))
    xy = F.array((c("k") * 10).cast("int"), F.lit(500))
    click, end = act("left_click", xy), act("terminate", None, "success")
    cases = [
        F.array(act("left_click", F.array(F.lit(1), F.lit(1))), click, end), F.array(click), F.array(end), F.array(end, click), F.array(click, act("terminate", None, "failure")),
        F.array(act("left_click", F.array(F.lit(1001), F.lit(5))), end), F.array(act("drag", xy), end), F.array(click, click, click, click, end),
    ]
    pick = cases[0]
    for i, case in enumerate(cases[1:], 1):
        pick = F.when(c("id") % 8 == i, case).otherwise(pick)
    rows = t.boxes.withColumn("actions", pick)
    return rows.select("id", G.score_sequence(c("actions"), c("w"), c("h"), c("x1"), c("y1"), c("x2") + 200, c("y2") + 200).alias("v"))


@query(
    "geo.score_press",
    """SELECT id, hit AND id % 6 <> 3 AS hit, CASE id % 6 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 1 END AS errors, hit AND id % 6 = 0 AS success
FROM (SELECT id, px BETWEEN x1 AND x2 + 300 AND py BETWEEN y1 AND y2 + 300 AS hit FROM boxes)""",
)
def _(t: Tables):
    a = lambda kind, x=None, y=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("double") if x is None else x).alias("x"), (F.lit(None).cast("double") if y is None else y).alias("y"))
    move, down, up = a("mouse_move", c("px") / 2, c("py") / 2), a("mouse_down"), a("mouse_up")
    cases = [F.array(move, down, up), F.array(move, down), F.array(move, down, down, up), F.array(down, up), F.array(a("mouse_move", F.lit(-1.0), F.lit(0.0)), move, down, up), F.array(move, a("scroll"), down, up)]
    pick = cases[0]
    for i, case in enumerate(cases[1:], 1):
        pick = F.when(c("id") % 6 == i, case).otherwise(pick)
    rows = t.boxes.withColumn("actions", pick)
    s = G.score_press(c("actions"), F.lit(640.0), F.lit(360.0), c("w"), c("h"), c("x1"), c("y1"), c("x2") + 300, c("y2") + 300)
    return rows.select("id", s.alias("s")).select("id", "s.hit", "s.errors", "s.success")


@query("geo.path_valid", "SELECT id, id % 4 = 0 AND k < 80 AS v FROM boxes")
def _(t: Tables):
    """Ways from x = 0 to a box around x = 1000: straight, with a short step, backwards, or early inside; far starts leave the canvas."""
    pt = lambda x: F.struct(F.lit(x).cast("double").alias("x"), F.lit(100.0).alias("y"))
    ways = [F.array(pt(300), pt(700), pt(1000)), F.array(pt(300), pt(305), pt(1000)), F.array(pt(300), pt(200), pt(1000)), F.array(pt(300), pt(975), pt(1000))]
    pick = ways[0]
    for i, way in enumerate(ways[1:], 1):
        pick = F.when(c("id") % 4 == i, way).otherwise(pick)
    start = F.when(c("k") < 80, 0.0).otherwise(300.0)
    rows = t.boxes.withColumn("points", pick)
    z = lambda v: F.lit(float(v))
    return rows.select("id", G.path_valid(start, z(100), z(1000), z(100), c("points"), z(970), z(80), z(1040), z(120), 1280.0, 720.0).alias("v"))


@query("geo.visual_tokens", "SELECT id, CAST(floor(px / 28) * floor(py / 28) AS BIGINT) AS v FROM boxes")
def _(t: Tables):
    return t.boxes.select("id", G.visual_tokens(c("px"), c("py"), 28).cast("long").alias("v"))


@query("geo.rect_overlap", "SELECT id, abs(x1 - px) < 60 AND abs(y1 - py) < 60 AS v FROM boxes")
def _(t: Tables):
    return t.boxes.select("id", G.rect_overlap(c("x1"), c("y1"), c("px"), c("py"), 60).alias("v"))


@query("geo.overshoot", """WITH p AS (SELECT id, (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS norm, (px - x1) * (x2 - x1) + (py - y1) * (y2 - y1) AS a, (x2 + id % 5 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS z FROM boxes)
SELECT id, norm > 1e-6 AND coalesce(a / norm > 1.02 AND abs(z / norm - 1) <= 0.02, false) AS v FROM p""")
def _(t: Tables):
    """A box's diagonal is the way; the row's point comes first, the last ends beside the far corner."""
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    pts = F.array(pt(c("px"), c("py")), pt(c("x2") + c("id") % 5, c("y2")))
    return t.boxes.select("id", G.overshoots(pts, c("x1"), c("y1"), c("x2"), c("y2")).alias("v"))


# --- arrays -------------------------------------------------------------------


@query("geo.center_aggregate", "SELECT id, 500 + (k - 500) + (turns * 50 - 500.0::DOUBLE) AS v FROM records")
def _(t: Tables):
    return t.records.select("id", A.center_aggregate(F.array(c("k").cast("double"), (c("turns") * 50).cast("double"))).alias("v"))


@query("arr.compact_history", "SELECT id, array_to_string(list_slice(l, greatest(1, len(l) - 2), len(l)), ',') AS v FROM (SELECT id, list(pos ORDER BY pos) AS l FROM steps GROUP BY id)")
def _(t: Tables):
    pos = F.array_sort(F.collect_list("pos"))
    return t.steps.groupBy("id").agg(pos.alias("l")).select("id", F.array_join(A.last_n(c("l"), 3), ",").alias("v"))


@query("arr.loss_mask", "SELECT id, string_agg((CASE WHEN trainable THEN loss * attention ELSE 0 END)::VARCHAR, ',' ORDER BY pos) AS v FROM (SELECT id, pos, (kind = 'action')::INT AS loss, (n > 60)::INT AS attention, count(*) OVER (PARTITION BY id) % 2 = 0 AS trainable FROM steps) GROUP BY id")
def _(t: Tables):
    """Every conversation: its actions are trained on where attended, if it has an even number of steps."""
    g = t.steps.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", (c("kind") == "action").cast("int").alias("loss"), (c("n") > 60).cast("int").alias("attention")))).alias("s"))
    m = A.loss_mask(c("s.loss"), c("s.attention"), F.size("s") % 2 == 0)
    return g.select("id", F.array_join(m, ",").alias("v"))


@query("arr.drag_phases", """WITH g AS (SELECT episode, id // 50 AS part, string_agg(CASE variant WHEN 'error' THEN 'd' WHEN 'purchase' THEN 'u' ELSE 'm' END, '' ORDER BY id) AS s FROM records GROUP BY 1, 2)
SELECT episode, part, regexp_matches(s, '^m+dm+u$') AS ok, CASE WHEN regexp_matches(s, '^m+dm+u$') THEN instr(s, 'd') - 1 END::INT AS free, CASE WHEN regexp_matches(s, '^m+dm+u$') THEN length(s) - instr(s, 'd') - 1 END::INT AS held FROM g""")
def _(t: Tables):
    """An episode's events of fifty lines as a drag: errors press, purchases release, others move."""
    kind = F.when(c("variant") == "error", "mouse_down").when(c("variant") == "purchase", "mouse_up").otherwise("move_to")
    g = t.records.groupBy("episode", F.floor(c("id") / 50).alias("part")).agg(F.array_sort(F.collect_list(F.struct("id", kind.alias("kind")))).alias("s"))
    free, held, ok = A.drag_phases(F.transform("s", lambda x: x.kind))
    return g.select("episode", "part", ok.alias("ok"), free.cast("int").alias("free"), held.cast("int").alias("held"))


@query("arr.monotone_fractions", "SELECT id, greatest(turns, 1) AS n, CASE WHEN turns = 1 THEN 1.0 ELSE round(turns * 1.25 / 2, 6) END::DOUBLE AS s FROM records")
def _(t: Tables):
    f = A.monotone_fractions(c("turns"), 0.25)
    return t.records.select("id", F.size(f).cast("long").alias("n"), F.round(F.aggregate(f, F.lit(0.0), lambda s, x: s + x), 6).alias("s"))


@query("arr.reorder", "SELECT id, array_to_string(list_concat(l[1 : greatest(0, least(5, id % 7) - 1)], [id % 5]), ',') AS v FROM (SELECT id, list_filter([3, 1, 4, 0, 2], lambda x: x <> id % 5) AS l FROM records)")
def _(t: Tables):
    order = F.array(*[F.lit(i).cast("long") for i in (3, 1, 4)])
    full = F.array(*[F.lit(i).cast("long") for i in (3, 1, 4, 0, 2)])
    short = F.when(c("id") % 2 == 0, full).otherwise(F.concat(order, F.array(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    return t.records.select("id", F.array_join(A.reorder(short, c("id") % 5, c("id") % 7, 5), ",").alias("v"))


@query("win.order_prefix", "SELECT id, array_to_string(list_slice([3, 1, 4, 0, 2], 1, list_position([3, 1, 4, 0, 2], id % 5)), ',') AS v FROM records")
def _(t: Tables):
    order = F.array(*[F.lit(i).cast("long") for i in (3, 1, 4, 0, 2)])
    return t.records.select("id", F.array_join(A.order_prefix(order, c("id") % 5), ",").alias("v"))
