"""Queries of projections, filters, joins and set relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import hashing as H
from ..functions import jsonx as J
from ..functions import text as X
from ..operators import join as R
from ..operators import project as P
from ..operators import validate as V
from .catalog import Tables, query

c = F.col

# --- projections ----------------------------------------------------------------


@query("proj.simple_instruction", "SELECT id, CASE WHEN k % 3 > 0 THEN variant END AS v FROM records")
def _(t: Tables):
    text = F.when(c("k") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "variant", F.lit(" ")))
    nested = t.records.select("id", F.struct(text.alias("simple_instruction")).alias("all_instructions"))
    return nested.select("id", X.required_text(c("all_instructions.simple_instruction")).alias("v"))


@query("proj.identity_key", "SELECT id, id || '/' || platform || '/' || lower(category) AS v FROM cands WHERE category <> 'de'")
def _(t: Tables):
    key = F.struct("id", "platform", F.lower(X.required_text(F.when(c("category") == "de", " ").otherwise(c("category")))).alias("norm"))
    rows = t.cands.select("id", key.alias("key")).where("key.id IS NOT NULL AND key.platform IS NOT NULL AND key.norm IS NOT NULL")
    return rows.select("id", F.concat_ws("/", "key.id", "key.platform", "key.norm").alias("v"))


@query("proj.semantic_identity", """SELECT id, CASE WHEN variant = 'view' THEN '{"episode":' || episode || ',"variant":"view"}' ELSE '{"k":' || k || ',"variant":"' || variant || '"}' END AS v FROM records""")
def _(t: Tables):
    view = J.canonical_row(F.struct("variant", "episode"))
    return t.records.select("id", F.when(c("variant") == "view", view).otherwise(J.canonical_row(F.struct("variant", "k"))).alias("v"))


@query("proj.scene_identity", """SELECT id, '{"a":{"b":null,"z":' || turns || '},"k":' || k || '}' AS v FROM records""")
def _(t: Tables):
    text = F.concat(F.lit('{"k": '), c("k").cast("string"), F.lit(', "a": {"z": '), c("turns").cast("string"), F.lit('.0, "b": null}}'))
    return t.records.select("id", J.canonical(text).alias("v"))


@query("proj.target_identity", "SELECT id, variant || '|' || printf('%.6f', value) || '|' || printf('%.6f', k / 8) AS v FROM records")
def _(t: Tables):
    return t.records.select("id", F.concat_ws("|", "variant", F.format_string("%.6f", "value"), F.format_string("%.6f", c("k") / 8)).alias("v"))


def _content(t: Tables):
    part = lambda k, v: F.struct(F.lit(k).alias("type"), v.cast("string").alias("value"))
    return t.records.select("id", "split", F.array(part("text", c("variant")), part("image", c("k")), part("text", F.lit("!")), part("image", c("turns"))).alias("content"))


@query("proj.content_flatten", "SELECT id, variant || '<image>!<image>' AS text, k || ',' || turns AS images FROM records")
def _(t: Tables):
    text, images = P.flatten_content(c("content"))
    return _content(t).select("id", text.alias("text"), F.array_join(images, ",").alias("images"))


@query("proj.messages_row", "SELECT id, 'user' AS role, variant || '<image>!<image>' AS text, 2 AS images, 0 AS tools, split FROM records")
def _(t: Tables):
    rows = P.messages_row(_content(t), "content", ["id", "split"])
    return rows.select("metadata.id", F.get("messages", 0).role.alias("role"), F.get("messages", 0).content.alias("text"), F.size("images").alias("images"), F.size("tools").alias("tools"), "metadata.split")


def _task(t: Tables, agent: str, seed: int):
    rows = t.records.select("id", "variant", "split", "k", c("id").alias("row_index"), F.concat_ws(" ", F.lit("do"), "variant").alias("instruction"))
    out = P.task_row(rows, "millrace", agent, seed, c("variant"), ["k"], ["split"])
    return out.select("extra_info.row_index", "data_source", F.get("prompt", 0).content.alias("content"), "ability", "reward_model.style", "agent_name", "seed", "task_config.k", "extra_info.split")


_TASK = "SELECT id AS row_index, 'millrace' AS data_source, 'do ' || variant AS content, variant AS ability, 'rule' AS style, '{0}' AS agent_name, id + {1} AS seed, k, split FROM records"


@query("proj.grpo_row", _TASK.format("first", 1000))
def _(t: Tables):
    return _task(t, "first", 1000)


@query("proj.grpo_row.third", _TASK.format("third", 900000))
def _(t: Tables):
    return _task(t, "third", 900000)


@query("proj.track_row", "SELECT id, track, track || '-' || id AS row_id FROM records, (SELECT unnest(['direct', 'move', 'think']) AS track) WHERE split = 'test'")
def _(t: Tables):
    return P.per_track(t.records.where("split = 'test'").select("id"), ["direct", "move", "think"]).withColumn("row_id", F.concat_ws("-", "track", "id"))


def _typed(t: Tables):
    """Trajectories of typed steps: the last action is a click, the others moves."""
    last = F.max(F.when(c("kind") == "action", c("pos"))).over(Window.partitionBy("id"))
    kind = F.when(c("kind") != "action", "none").when(c("pos") == last, "click").otherwise("move")
    typed = t.steps.where("kind <> 'system'").select("id", "pos", c("kind").alias("type"), kind.alias("kind"), "x", "y")
    return P.trajectories(typed)


_KINDS = """typed AS (SELECT id, pos, kind AS type, x, y, CASE WHEN kind <> 'action' THEN 'none' WHEN pos = max(CASE WHEN kind = 'action' THEN pos END) OVER (PARTITION BY id) THEN 'click' ELSE 'move' END AS k FROM steps WHERE kind <> 'system')"""


@query("proj.action_semantics", f"WITH {_KINDS} SELECT id, string_agg(CASE k WHEN 'move' THEN 'left_click' WHEN 'click' THEN 'terminate' ELSE k END, ',' ORDER BY pos) AS v FROM typed GROUP BY id")
def _(t: Tables):
    s = P.remap_kinds(c("steps"), {"move": "left_click", "click": "terminate"})
    return _typed(t).select("id", F.array_join(F.transform(s, lambda x: x.kind), ",").alias("v"))


@query("proj.final_click", f"""WITH {_KINDS} SELECT id, min(CASE WHEN type = 'observation' THEN pos END) AS image, max(CASE WHEN k = 'move' THEN pos END) AS pos,
  arg_max(x, CASE WHEN k = 'move' THEN pos END) AS x, arg_max(y, CASE WHEN k = 'move' THEN pos END) AS y FROM typed GROUP BY id""")
def _(t: Tables):
    obs, move = P.final_click(c("steps"))
    return _typed(t).select("id", obs.pos.alias("image"), move.pos.alias("pos"), move.x.alias("x"), move.y.alias("y"))


@query("proj.sanitize", "SELECT id, CASE WHEN k % 2 = 0 THEN 'turns=' || turns || ',variant=' || variant ELSE 'variant=' || variant END AS v FROM records")
def _(t: Tables):
    m = F.map_from_arrays(F.array(F.lit("variant"), F.lit("turns"), F.lit("secret")), F.array(c("variant"), F.when(c("k") % 2 == 0, c("turns").cast("string")), F.lit("x")))
    kept = F.array_sort(F.map_entries(P.keep_keys(m, ["variant", "turns"])))
    return t.records.select("id", F.array_join(F.transform(kept, lambda e: F.concat_ws("=", e.key, e.value)), ",").alias("v"))


@query("proj.audit", "SELECT id, string_agg(DISTINCT substr(sha256(role), 1, 8), ',' ORDER BY substr(sha256(role), 1, 8)) AS hashes, count(*) FILTER (WHERE kind = 'action') AS actions FROM steps GROUP BY id")
def _(t: Tables):
    h = F.substring(F.sha2("role", 256), 1, 8)
    return t.steps.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(h)), ",").alias("hashes"), F.count_if(c("kind") == "action").alias("actions"))


@query("proj.drop_nulls", "SELECT id, CASE WHEN k % 2 = 0 THEN '{\"a\":1,\"b\":' || k || '}' ELSE '{\"a\":1}' END AS v, 1 + (k % 2 = 0)::INT AS n FROM records")
def _(t: Tables):
    maybe = F.when(c("k") % 2 == 0, c("k"))
    return t.records.select("id", F.to_json(F.struct(F.lit(1).alias("a"), maybe.alias("b"))).alias("v"), F.size(P.drop_nulls(F.array(F.lit(1).cast("long"), maybe))).alias("n"))


@query("proj.companion", "SELECT id, 'first' AS view, turns FROM records UNION ALL SELECT id, 'third', turns * 2 FROM records")
def _(t: Tables):
    first = t.records.select("id", F.lit("first").alias("view"), "turns")
    return P.companion(first, {"view": F.lit("third"), "turns": c("turns") * 2})


@query(
    "proj.image_history",
    """SELECT s.id, s.pos, array_to_string(list_slice(o, greatest(1, len(o) - 2), len(o)), ',') AS images, array_to_string(a, ',') AS responses FROM (
  SELECT id, pos, kind, list(pos) FILTER (WHERE kind = 'observation') OVER w AS o, list(pos) FILTER (WHERE kind = 'action') OVER w AS a FROM steps
  WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) s WHERE kind = 'action'""".replace("array_to_string(list_slice(o, greatest(1, len(o) - 2), len(o)), ',')", "coalesce(array_to_string(list_slice(o, greatest(1, len(o) - 2), len(o)), ','), '')").replace("array_to_string(a, ',') AS", "coalesce(array_to_string(a, ','), '') AS"),
)
def _(t: Tables):
    return P.history(t.steps).select("id", "pos", F.array_join("images", ",").alias("images"), F.array_join("responses", ",").alias("responses"))


@query("proj.explode_actions", "SELECT id, pos, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS action_index, row_number() OVER (PARTITION BY id % 6 ORDER BY id, pos) - 1 AS row_index FROM steps WHERE kind = 'action'")
def _(t: Tables):
    return P.explode_actions(t.steps.withColumn("variant", c("id") % 6), "variant").select("id", "pos", "action_index", "row_index")


@query("proj.observations_before_action", "SELECT id, pos, CASE WHEN k = 'observation' THEN p END AS observed FROM (SELECT id, pos, kind, lag(kind) OVER w AS k, lag(pos) OVER w AS p FROM steps WINDOW w AS (PARTITION BY id ORDER BY pos)) WHERE kind = 'action'")
def _(t: Tables):
    return P.with_observation(t.steps).select("id", "pos", "observed")


@query("proj.normalize_action", """SELECT id, '{"kind":"' || variant || '","x":' || k || '}' AS v FROM records""")
def _(t: Tables):
    step = F.struct(c("variant").alias("kind"), c("k").alias("x"), c("id").alias("step_index"), F.lit(True).alias("trainable"), F.lit(None).cast("string").alias("image"))
    return t.records.select("id", F.to_json(step.dropFields("step_index", "trainable", "image")).alias("v"))


@query("proj.input_key", "SELECT id, variant || '/' || k || CASE WHEN turns > 10 THEN '/' || split ELSE '' END AS v FROM records")
def _(t: Tables):
    key = F.struct(c("variant").alias("instruction"), c("k").alias("image"), F.when(c("turns") > 10, c("split")).alias("context"))
    return t.records.select("id", key.alias("key")).select("id", F.concat_ws("/", "key.instruction", "key.image", "key.context").alias("v"))


# --- filters and rules ------------------------------------------------------------


@query("filter.variant", "SELECT id, episode FROM records WHERE variant = 'purchase'")
def _(t: Tables):
    return t.records.where(c("variant") == "purchase").select("id", "episode").orderBy("id")


@query("filter.lookup_one", "SELECT id, variant, 1 AS n FROM records WHERE id = 77")
def _(t: Tables):
    hit = t.records.where((c("variant") == "none") | (c("id") == 77))
    return hit.select("id", "variant", F.count("*").over(Window.partitionBy()).alias("n")).where("n = 1")


_REJECT = """WITH r AS (SELECT id, platform, category, text, CASE WHEN n < 100 THEN 'short' WHEN regexp_matches(text, '!!') THEN 'shouting' WHEN category = 'de' THEN 'category' WHEN id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'held_out' END AS reason FROM cands),
f AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY id) AS nth FROM r WHERE reason IS NULL) """


@query("filter.candidates", _REJECT + "SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (SELECT reason FROM r WHERE reason IS NOT NULL UNION ALL SELECT CASE WHEN nth > 1 THEN 'duplicate' END FROM f) GROUP BY 1")
def _(t: Tables):
    held = t.labels.where("toxic = 1").select(c("doc_id").alias("id"), F.lit(True).alias("held")).distinct()
    rows = t.cands.join(held, "id", "left")
    good, bad = V.split_rejects(rows, [("short", c("n") < 100), ("shouting", c("text").contains("!!")), ("category", c("category") == "de"), ("held_out", F.coalesce("held", F.lit(False)))])
    nth = F.row_number().over(Window.partitionBy(F.sha2("text", 256)).orderBy("id"))
    first = good.select(F.when(nth > 1, "duplicate").alias("reason"))
    return bad.select("reason").unionByName(first).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("filter.finite_bbox", "SELECT id, x2 - x1 AS v FROM boxes WHERE k % 5 > 0 AND y1 < y2 AND x1 < x2")
def _(t: Tables):
    box = F.array("x1", "y1", "x2", F.when(c("k") % 5 == 0, F.lit(float("nan"))).otherwise(c("y2")))
    return t.boxes.select("id", V.finite_bbox(box).alias("b")).where("b IS NOT NULL").select("id", (c("b")[2] - c("b")[0]).alias("v"))


@query(
    "filter.bbox_reason",
    """SELECT id, CASE WHEN k % 11 = 0 THEN 'missing_bbox' WHEN k % 11 = 1 THEN 'bbox_non_finite' WHEN x2 <= x1 OR y2 <= y1 THEN 'bbox_non_positive' WHEN x2 > w OR y2 > h THEN 'bbox_outside_canvas' WHEN x2 - x1 < 24 THEN 'bbox_width_below_minimum'
  WHEN y2 - y1 < 18 THEN 'bbox_height_below_minimum' WHEN (x2 - x1) * (y2 - y1) < 600 THEN 'bbox_area_below_minimum' WHEN (x2 - x1) * (y2 - y1) / (w * h) > 0.01 THEN 'bbox_area_ratio_above_maximum' END AS v FROM boxes""",
)
def _(t: Tables):
    x1 = F.when(c("k") % 11 == 0, F.lit(None).cast("double")).when(c("k") % 11 == 1, F.lit(float("inf"))).otherwise(c("x1"))
    return t.boxes.select("id", V.bbox_reason(x1, c("y1"), c("x2"), c("y2"), c("w"), c("h"), most_share=0.01).alias("v"))


@query("filter.aligned_arrays", "SELECT id, id % 3 = 0 AS ok, CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END AS n FROM records")
def _(t: Tables):
    a, b = F.array("k", "turns"), F.when(c("id") % 3 == 0, F.array("turns", "k")).otherwise(F.array("k"))
    rows = t.records.select("id", a.alias("a"), b.alias("b"))
    ok = V.aligned([c("a"), c("b")], F.lit(2))
    return rows.select("id", ok.alias("ok"), F.when(ok, F.size(F.arrays_zip("a", "b"))).otherwise(0).alias("n"))


@query(
    "filter.source_contract",
    f"""WITH {_KINDS}, g AS (SELECT id, count(*) AS n, string_agg(type, ' ' ORDER BY pos) AS types, count(*) FILTER (WHERE k = 'move') AS moves, count(*) FILTER (WHERE k = 'click') AS clicks FROM typed GROUP BY id)
SELECT id, CASE WHEN NOT regexp_matches(types, '^(observation action ?)*(observation)?$') THEN 'not_alternating' WHEN n % 2 = 1 THEN 'odd_end' WHEN clicks = 0 THEN 'no_click' WHEN moves < 1 OR moves > 3 THEN 'moves' END AS v FROM g""",
)
def _(t: Tables):
    return _typed(t).select("id", V.source_contract(c("steps")).alias("v"))


@query("filter.coordinate", "SELECT id, px <= 1000 AND id % 9 > 0 AS v FROM boxes")
def _(t: Tables):
    xy = F.array(c("px").cast("int"), F.when(c("id") % 9 > 0, c("py").cast("int")))
    return t.boxes.select("id", ((F.size(xy) == 2) & F.forall(xy, lambda v: F.coalesce(v.between(0, 1000), F.lit(False)))).alias("v"))


@query("filter.trace_sequence", "SELECT episode, k % 10 AS part, regexp_matches(string_agg(CASE variant WHEN 'view' THEN 'down' WHEN 'error' THEN 'up' ELSE 'move' END, ' ' ORDER BY id), '^(move )+down up$') AS v FROM records GROUP BY 1, 2")
def _(t: Tables):
    """Short sequences out of all rows: an episode's rows by the last digit of k."""
    kind = F.when(c("variant") == "view", "down").when(c("variant") == "error", "up").otherwise("move")
    s = t.records.groupBy("episode", (c("k") % 10).alias("part")).agg(F.array_sort(F.collect_list(F.struct("id", kind.alias("kind")))).alias("s"))
    return s.select("episode", "part", V.scan_sequence(F.transform("s", lambda x: x.kind)).alias("v"))


@query("filter.observation_sequence", "SELECT id, bool_and(p IS NULL OR pos = p + 1) AND min(pos) = 0 AS v FROM (SELECT id, pos, lag(pos) OVER (PARTITION BY id ORDER BY pos) AS p FROM steps) GROUP BY id")
def _(t: Tables):
    prev = F.lag("pos").over(Window.partitionBy("id").orderBy("pos"))
    return t.steps.select("id", "pos", prev.alias("p")).groupBy("id").agg((F.bool_and(c("p").isNull() | (c("pos") == c("p") + 1)) & (F.min("pos") == 0)).alias("v"))


@query("filter.forbidden_keys", "SELECT 'row.meta.answer' AS path UNION ALL SELECT 'row.steps[].oracle'")
def _(t: Tables):
    rows = t.records.select("id", F.struct(c("k").alias("answer"), "split").alias("meta"), F.array(F.struct(c("turns").alias("oracle"))).alias("steps"))
    found = V.forbidden_fields(rows.schema, ["answer", "oracle"])
    return t.spark.createDataFrame([(p,) for p in found], "path string")


_KEYS = (*V.ORACLE_KEYS, "the", "a", "so")
_FIRST = r"([A-Za-z]+)"


@query("filter.oracle_keys", "SELECT id, lower(regexp_extract(text, '" + _FIRST + "', 1)) IN ('" + "', '".join(_KEYS) + "') AS v FROM cands WHERE text IS NOT NULL")
def _(t: Tables):
    """The first word of every text as a nested key."""
    text = F.concat(F.lit('{"b":[{"'), F.regexp_extract("text", _FIRST, 1), F.lit('" : 1}]}'))
    return t.cands.where("text IS NOT NULL").select("id", V.json_has_key(text, _KEYS).alias("v"))


@query("filter.clean", r"""WITH r AS (SELECT id, lower(text || ' {"' || platform || '_sha' || id || '": 1, "' || category || 'hash": 2}') AS x FROM cands UNION ALL SELECT -id - 1, lower(text) FROM cands)
SELECT id, NOT regexp_matches(x, '</?think>') AND len(list_filter(regexp_extract_all(x, '"([^"\\]*)"\s*:', 1), lambda k: regexp_matches(k, '(^|[_-])(sha(\d+)?|hash|digest)($|[_-])'))) = 0 AS v FROM r""")
def _(t: Tables):
    """Every text, alone (under -id - 1) and with a JSON row behind it whose keys are made of its columns."""
    keyed = F.concat("text", F.lit(' {"'), "platform", F.lit("_sha"), c("id").cast("string"), F.lit('": 1, "'), "category", F.lit('hash": 2}'))
    rows = t.cands.select("id", keyed.alias("x")).unionByName(t.cands.select((-c("id") - 1).alias("id"), c("text").alias("x")))
    return rows.select("id", V.publishable(c("x")).alias("v"))


@query("filter.prompt_leak", "SELECT id, " + " OR ".join(f"contains(lower(text), '{w}')" for w in (*V.PRIVATE_WORDS, "thing", "attion")) + " AS v FROM cands")
def _(t: Tables):
    """Every text as the content of a prompt; two ordinary words are private here too."""
    prompt = F.array(F.struct(F.lit("user").alias("role"), c("text").alias("content")))
    return t.cands.select("id", V.has_word(F.to_json(prompt), (*V.PRIVATE_WORDS, "thing", "attion")).alias("v"))


@query("filter.policy_keys", "SELECT id, array_to_string(list_sort(list_filter(string_split(lower(category || ' ' || platform || '_oracle ' || coalesce(text, '')), ' '), lambda w: " + " OR ".join(f"contains(w, '{p}')" for p in V.EVALUATOR_PARTS) + ")), ',') AS v FROM cands WHERE text IS NOT NULL")
def _(t: Tables):
    """The words of every text as keys, with two made of its columns."""
    keys = F.split(F.concat_ws(" ", "category", F.concat("platform", F.lit("_oracle")), "text"), " ")
    return t.cands.where("text IS NOT NULL").select("id", F.array_join(V.leaking_keys(keys), ",").alias("v"))


@query("filter.non_click", "SELECT id, pos, NOT regexp_matches(s, '(?i){}') AND NOT regexp_matches(s, '(?i){}') AND (regexp_matches(s, '(?i){}') OR regexp_matches(s, '(?i){}') OR regexp_matches(s, '(?i){}')) AS v FROM (SELECT id, pos, CASE x % 4 WHEN 0 THEN 'move the mouse ' WHEN 1 THEN 'the cursor is placed ' WHEN 2 THEN 'then select ' ELSE '' END || text AS s FROM steps)".format(X.CLICKS, X.SELECTS, X.HOVERS, X.CURSOR_MOVES, X.CURSOR_STATES))
def _(t: Tables):
    """Every text of the conversations, some behind the beginning of an instruction."""
    lead = F.when(c("x") % 4 == 0, "move the mouse ").when(c("x") % 4 == 1, "the cursor is placed ").when(c("x") % 4 == 2, "then select ").otherwise("")
    return t.steps.select("id", "pos", X.cursor_only(F.concat(lead, "text")).alias("v"))


@query("filter.record_contract", "SELECT id FROM records WHERE variant = 'click' AND split = 'train' AND success AND k >= 10 AND turns <= 12")
def _(t: Tables):
    want = {"variant": "click", "split": "train", "success": True}
    keep = (c("k") >= 10) & (c("turns") <= 12)
    for name, value in want.items():
        keep = keep & c(name).eqNullSafe(F.lit(value))
    return t.records.where(keep).select("id")


_THOUGHTS = "(SELECT id, pos, CASE x % 5 WHEN 0 THEN regexp_replace(text, '[A-Za-z]', '', 'g') WHEN 1 THEN text || ' 中' WHEN 2 THEN text || ' by the Oracle' WHEN 3 THEN '<Think>' || text ELSE text END AS s FROM steps)"


@query("filter.think_quality", "SELECT id, pos, concat_ws(',', CASE WHEN trim(s) = '' THEN 'empty' END, CASE WHEN NOT regexp_matches(s, '[A-Za-z]') THEN 'no_latin' END, CASE WHEN regexp_matches(s, '{}') THEN 'cjk' END, CASE WHEN {} THEN 'forbidden' END, CASE WHEN regexp_matches(lower(s), '</?think>') THEN 'nested_tag' END) AS v FROM {}".format(X.CJK, " OR ".join(f"contains(lower(s), '{p}')" for p in X.FORBIDDEN), _THOUGHTS))
def _(t: Tables):
    """Every text of the conversations as a thought, four in five of them spoilt in one way."""
    s = F.when(c("x") % 5 == 0, F.regexp_replace("text", "[A-Za-z]", "")).when(c("x") % 5 == 1, F.concat("text", F.lit(" 中"))).when(c("x") % 5 == 2, F.concat("text", F.lit(" by the Oracle"))).when(c("x") % 5 == 3, F.concat(F.lit("<Think>"), "text")).otherwise(c("text"))
    return t.steps.select("id", "pos", X.think_issues(s).alias("v"))


_SAID = "(SELECT id, lower(CASE WHEN id % 4 = 1 THEN text || ' ' || repeat(right(text, 40) || ' ', 3) ELSE text END) AS s FROM cands WHERE text IS NOT NULL)"


@query("filter.repetition", f"""WITH s AS {_SAID}, w AS (SELECT id, s, regexp_extract_all(s, '[a-z0-9_]+') AS t FROM s),
g AS (SELECT id, list_transform(range(1, greatest(len(t) - 2, 1)), lambda i: array_to_string(t[i : i + 3], ' ')) AS g FROM w),
c AS (SELECT id, max(n) AS most, count(*) AS different, sum(n) AS grams FROM (SELECT id, x, count(*) AS n FROM (SELECT id, unnest(g) AS x FROM g) GROUP BY id, x) GROUP BY id),
d AS (SELECT id, list_filter(list_transform(string_split_regex(s, '{X.SENTENCE_ENDS}'), lambda x: regexp_extract_all(x, '[a-z0-9_]+')), lambda x: len(x) >= 6) AS d FROM w)
SELECT id, CASE WHEN len(t) < 24 THEN '' ELSE concat_ws(',', CASE WHEN len(list_distinct(list_transform(d, lambda x: array_to_string(x, ' ')))) < len(d) THEN 'duplicate_sentence' END,
  CASE WHEN grams >= 20 AND different / grams < 0.55 AND most >= 3 THEN 'ngram' END,
  CASE WHEN len(list_filter(range(4, 21), lambda n: len(t) >= 3 * n AND t[len(t) - n + 1 : len(t)] = t[len(t) - 2 * n + 1 : len(t) - n] AND t[len(t) - n + 1 : len(t)] = t[len(t) - 3 * n + 1 : len(t) - 2 * n])) > 0 THEN 'tail' END) END AS v
FROM w JOIN d USING (id) LEFT JOIN c USING (id)""")
def _(t: Tables):
    """Every text, one in four with its end three times over."""
    said = F.when(c("id") % 4 == 1, F.concat("text", F.lit(" "), F.repeat(F.concat(F.right("text", F.lit(40)), F.lit(" ")), 3))).otherwise(c("text"))
    return t.cands.where("text IS NOT NULL").select("id", X.repetition_issues(said).alias("v"))


@query("filter.loop", "SELECT episode, coalesce(l[-1] = l[-2], false) OR coalesce(l[-1] = l[-3] AND l[-2] = l[-4] AND l[-1] <> l[-2], false) AS v FROM (SELECT episode, list(variant ORDER BY id) AS l FROM records GROUP BY episode)")
def _(t: Tables):
    s = t.records.groupBy("episode").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "variant"))), lambda x: x.variant).alias("l"))
    return s.select("episode", A.repeats(c("l")).alias("v"))


@query("filter.meaningful_delta", "SELECT id, abs(k - lag_k) * 1e-10 > 1e-9 OR abs(value - lag_v) > 1e-9 AS v FROM (SELECT id, k, floor(value / 40) AS value, lag(k, 1, k) OVER w AS lag_k, lag(floor(value / 40), 1, floor(value / 40)) OVER w AS lag_v FROM records WINDOW w AS (PARTITION BY episode ORDER BY id))")
def _(t: Tables):
    """What changed since the row before: a tiny unit of k, and the value's step of forty."""
    w = Window.partitionBy("episode").orderBy("id")
    step = F.floor(c("value") / 40)
    moved = t.records.select("id", (c("k") - F.coalesce(F.lag("k").over(w), c("k"))).alias("k"), (step - F.coalesce(F.lag(step).over(w), step)).cast("double").alias("v"))
    return moved.select("id", V.meaningful(F.create_map(F.lit("k"), c("k") * 1e-10, F.lit("v"), c("v"))).alias("v"))


@query("filter.range", "SELECT id, value FROM records WHERE value BETWEEN 12.5 AND 40 AND k BETWEEN 10 AND 20")
def _(t: Tables):
    return t.records.where(c("value").between(12.5, 40) & c("k").between(10, 20)).select("id", "value")


@query("filter.trainable", "SELECT id FROM records WHERE NOT (k % 5 = 0) AND NOT (k % 7 = 0)")
def _(t: Tables):
    rows = t.records.select("id", F.when(c("k") % 5 == 0, False).alias("trainable"), F.when(c("k") % 7 == 0, 0.0).alias("loss_weight"))
    return rows.where(F.coalesce("trainable", F.lit(True)) & (F.coalesce("loss_weight", F.lit(1.0)) > 0)).select("id")


# --- joins ------------------------------------------------------------------------


@query("join.hash.lookup", "SELECT r.id, u.n FROM records r LEFT JOIN (SELECT episode, count(*) AS n FROM records WHERE success GROUP BY episode HAVING count(*) > 30) u USING (episode)")
def _(t: Tables):
    source = t.records.where("success").groupBy("episode").agg(F.count("*").alias("n")).where("n > 30")
    return t.records.join(source, "episode", "left").select("id", "n")


@query("join.hash.composite", "SELECT r.id, m.top FROM records r JOIN (SELECT episode, variant, max(k) AS top FROM records GROUP BY 1, 2) m USING (episode, variant)")
def _(t: Tables):
    m = t.records.groupBy("episode", "variant").agg(F.max("k").alias("top"))
    return t.records.join(m, ["episode", "variant"]).select("id", "top")


@query("join.zip", """SELECT a.id AS a_id, b.id AS b_id, coalesce(a.episode, b.episode) AS episode FROM (SELECT id, episode, row_number() OVER (PARTITION BY episode ORDER BY id) AS p FROM records WHERE success) a
FULL JOIN (SELECT id, episode, row_number() OVER (PARTITION BY episode ORDER BY id) AS p FROM records WHERE NOT success) b ON a.episode = b.episode AND a.p = b.p""")
def _(t: Tables):
    a, b = t.records.where("success").select("episode", c("id").alias("a_id")), t.records.where("NOT success").select("episode", c("id").alias("b_id"))
    return R.zipped(a, b, ["a_id"], ["b_id"], "episode").select("a_id", "b_id", "episode")


@query("join.zip.fields", "SELECT id, (k % 3 = 0)::INT + (turns % 2 = 0)::INT AS differs FROM records")
def _(t: Tables):
    teacher, raw = F.array("k", "turns", "id"), F.array(F.when(c("k") % 3 == 0, c("k") + 1).otherwise(c("k")), F.when(c("turns") % 2 == 0, -c("turns")).otherwise(c("turns")), c("id"))
    same = F.zip_with(teacher, raw, lambda a, b: a.eqNullSafe(b))
    return t.records.select("id", F.size(F.filter(same, lambda x: ~x)).alias("differs"))


@query("join.anti.sft", "SELECT id FROM cands WHERE id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t: Tables):
    sft = t.labels.where("quality = 1").select(c("doc_id").alias("id")).distinct()
    return t.cands.select("id").join(sft, "id", "left_anti")


@query("join.semi.ids", "SELECT id FROM cands WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(t: Tables):
    return t.cands.select("id").join(t.labels.where("toxic = 1").select(c("doc_id").alias("id")), "id", "left_semi")


@query("join.semi.episode", "SELECT id FROM records WHERE success AND episode IN (SELECT episode FROM records WHERE split = 'val' AND k > 90)")
def _(t: Tables):
    chosen = t.records.where("split = 'val' AND k > 90").select("episode")
    return t.records.where("success").join(chosen, "episode", "left_semi").select("id")


@query("join.full.coverage", """SELECT coalesce(e.id, o.id) AS id, CASE WHEN o.n IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'unexpected' ELSE 'duplicate' END AS status, coalesce(o.n, 0) AS n
FROM (SELECT DISTINCT episode AS id FROM records WHERE episode < 100) e FULL JOIN (SELECT episode AS id, count(*) AS n FROM records WHERE value > 200 GROUP BY 1) o ON e.id = o.id WHERE o.n IS NULL OR e.id IS NULL OR o.n > 1""")
def _(t: Tables):
    e = t.records.where("episode < 100").select(c("episode").alias("id"))
    return R.coverage(e, t.records.where("value > 200").select(c("episode").alias("id")), "id")


@query("join.full.cursor_map", "SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS in_map, b.k IS NOT NULL AS in_samples FROM (SELECT DISTINCT k FROM records WHERE variant = 'view') a FULL JOIN (SELECT DISTINCT k FROM records WHERE value > 150) b ON a.k = b.k")
def _(t: Tables):
    keys = t.records.where("variant = 'view'").select(F.create_map(c("k"), c("turns")).alias("m")).select(F.explode(F.map_keys("m")).alias("k")).distinct().withColumn("a", F.lit(True))
    samples = t.records.where("value > 150").select("k").distinct().withColumn("b", F.lit(True))
    return keys.join(samples, "k", "full").select("k", c("a").isNotNull().alias("in_map"), c("b").isNotNull().alias("in_samples"))


_PAIRS = "(SELECT episode, max(k) AS top, min(turns) AS low, count(*) AS n FROM records WHERE variant = '{}' GROUP BY 1)"


@query("join.pair.self", f"SELECT episode, concat_ws(',', CASE WHEN a.top <> b.top THEN 'top' END, CASE WHEN a.low <> b.low THEN 'low' END, CASE WHEN a.n <> b.n THEN 'n' END) AS v FROM {_PAIRS.format('view')} a JOIN {_PAIRS.format('click')} b USING (episode)")
def _(t: Tables):
    g = t.records.groupBy("episode", "variant").agg(F.max("k").alias("top"), F.min("turns").alias("low"), F.count("*").alias("n"))
    return R.pair_differences(g, "episode", "variant", "view", "click", ["top", "low", "n"]).select("episode", F.array_join("differs", ",").alias("v"))


@query("join.pair.expand", f"SELECT episode, a.top AS first_top, b.top AS third_top, a.low = b.low AS same_scene FROM {_PAIRS.format('error')} a FULL JOIN {_PAIRS.format('signup')} b USING (episode)")
def _(t: Tables):
    g = t.records.groupBy("episode", "variant").agg(F.max("k").alias("top"), F.min("turns").alias("low"))
    a = g.where("variant = 'error'").select("episode", c("top").alias("first_top"), c("low").alias("a_low"))
    b = g.where("variant = 'signup'").select("episode", c("top").alias("third_top"), c("low").alias("b_low"))
    return a.join(b, "episode", "full").select("episode", "first_top", "third_top", (c("a_low") == c("b_low")).alias("same_scene"))


@query("join.matched_arms", "SELECT episode, CASE WHEN good = arms AND arms = 5 THEN 'kept' WHEN good = 0 THEN 'intrinsic' ELSE 'paired' END AS status FROM (SELECT episode, count(*) FILTER (WHERE top > 250) AS good, count(*) AS arms FROM (SELECT episode, variant, sum(value) AS top FROM records GROUP BY 1, 2) GROUP BY 1)")
def _(t: Tables):
    arms = t.records.groupBy("episode", "variant").agg(F.sum("value").alias("top"))
    return R.in_all_arms(arms, "episode", "variant", 5, c("top") > 250).select("episode", "status")


@query("join.reuse", "SELECT id, CASE WHEN k % 3 = 0 AND turns > 5 THEN 'old' ELSE 'new' END AS note, k % 3 = 0 AND turns > 5 AS reused FROM records")
def _(t: Tables):
    new = t.records.select("id", "turns", F.lit("new").alias("note"))
    old = t.records.where("k % 3 = 0").select("id", F.when(c("turns") > 5, c("turns")).otherwise(-1).alias("turns"), F.lit("old").alias("note"))
    return R.reuse(new, old, ["id"], ["turns"], "note").select("id", "note", "reused")


@query("join.cache", "SELECT id, k % 2 = 0 AS hit, CASE WHEN k % 2 = 0 THEN 'cached' ELSE 'computed' END AS v FROM records")
def _(t: Tables):
    rows = t.records.withColumn("fp", H.sha_text(c("variant"), c("id"), c("turns")))
    cache = rows.where("k % 2 = 0").select("fp", F.lit("cached").alias("kept"))
    return rows.join(cache, "fp", "left").select("id", c("kept").isNotNull().alias("hit"), F.coalesce("kept", F.lit("computed")).alias("v"))


@query("join.asof.prev", """SELECT a.id, (SELECT max(b.id) FROM records b WHERE b.episode = a.episode AND b.variant = 'purchase' AND b.id <= a.id) AS v FROM records a WHERE a.variant = 'error'""")
def _(t: Tables):
    left = t.records.where("variant = 'error'").select("id", "episode", c("id").alias("at"))
    right = t.records.where("variant = 'purchase'").select("episode", c("id").alias("at"), c("id").alias("v"))
    return R.asof(left, right, ["episode"], "at", "v").select("id", "v")


@query("join.results.compare", """SELECT count(*) FILTER (WHERE a = b) AS agree, count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE NOT a AND b) AS only_b, count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE NOT a AND NOT b) AS neither, count(*) FILTER (WHERE a IS NULL OR b IS NULL) AS unmatched
FROM (SELECT id, success AS a FROM records WHERE turns < 18) x FULL JOIN (SELECT id, k > 50 AS b FROM records WHERE turns > 2) y USING (id)""")
def _(t: Tables):
    return R.compare_runs(t.records.where("turns < 18"), t.records.where("turns > 2").select("id", (c("k") > 50).alias("success")), "id", "success")


@query("join.phase.compare", "SELECT round(a.v / b.v, 6) AS ratio, a.n - b.n AS delta FROM (SELECT avg(value) AS v, count(*) AS n FROM records WHERE variant = 'view') a, (SELECT avg(value) AS v, count(*) AS n FROM records WHERE variant = 'click') b")
def _(t: Tables):
    one = lambda v: t.records.where(c("variant") == v).agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    a, b = one("view").select(c("v").alias("av"), c("n").alias("an")), one("click").select(c("v").alias("bv"), c("n").alias("bn"))
    return a.crossJoin(b).select(F.round(c("av") / c("bv"), 6).alias("ratio"), (c("an") - c("bn")).alias("delta"))


@query("join.shared_ids", "SELECT variant, count(*) AS n, round(median(value), 6) AS v FROM records WHERE episode IN (SELECT episode FROM records WHERE variant = 'view' AND k > 80 INTERSECT SELECT episode FROM records WHERE variant = 'click' AND k > 80) GROUP BY variant")
def _(t: Tables):
    of = lambda v: t.records.where((c("variant") == v) & (c("k") > 80)).select("episode")
    return t.records.join(of("view").intersect(of("click")), "episode", "left_semi").groupBy("variant").agg(F.count("*").alias("n"), F.round(F.median("value"), 6).alias("v"))


@query("join.theta.nearest_icon", "SELECT id, list_position(list_transform([100, 400, 700, 1000], lambda x: abs(px - x) <= 60), true) AS v FROM boxes")
def _(t: Tables):
    centers = F.array(*[F.lit(float(x)) for x in (100, 400, 700, 1000)])
    hit = F.array_position(F.transform(centers, lambda x: F.abs(c("px") - x) <= 60), True)
    return t.boxes.select("id", F.nullif(hit, F.lit(0)).cast("long").alias("v"))


@query("join.theta.aabb", "SELECT a.id AS a, b.id AS b FROM boxes a JOIN boxes b ON a.episode = b.episode AND a.id < b.id AND abs(a.px - b.px) < 20 AND abs(a.py - b.py) < 20")
def _(t: Tables):
    """Overlaps of 20-pixel squares in an episode, found on a grid: a square meets only those of its own and the neighbouring cells."""
    b = t.boxes.select("episode", "id", "px", "py", F.floor(c("px") / 20).alias("gx"), F.floor(c("py") / 20).alias("gy"))
    near = b.withColumn("dx", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))).withColumn("dy", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])))
    left = near.select("episode", c("id").alias("a"), c("px").alias("ax"), c("py").alias("ay"), (c("gx") + c("dx")).alias("gx"), (c("gy") + c("dy")).alias("gy"))
    return left.join(b, ["episode", "gx", "gy"]).where((c("a") < c("id")) & (F.abs(c("ax") - c("px")) < 20) & (F.abs(c("ay") - c("py")) < 20)).select("a", c("id").alias("b"))


@query("join.theta.min_distance", "SELECT id, round(least(abs(k - turns * 5), abs(k - 100), abs(turns * 5 - 100))::DOUBLE, 6) AS v FROM records")
def _(t: Tables):
    """Over three points of a row, by index pairs i < j."""
    p = F.array(c("k").cast("double"), (c("turns") * 5).cast("double"), F.lit(100.0))
    d = F.flatten(F.transform(p, lambda x, i: F.transform(F.slice(p, i + 2, 3), lambda y: F.abs(x - y))))
    return t.records.select("id", F.round(F.array_min(d), 6).alias("v"))


@query("join.cyclic_index", "SELECT a.id, b.k FROM (SELECT id, variant, row_number() OVER (PARTITION BY variant ORDER BY id) - 1 AS i FROM records WHERE success) a JOIN (SELECT k, variant, row_number() OVER (PARTITION BY variant ORDER BY id) - 1 AS j, count(*) OVER (PARTITION BY variant) AS n FROM records WHERE NOT success) b ON a.variant = b.variant AND a.i % b.n = b.j")
def _(t: Tables):
    a = t.records.where("success").select("id", "variant")
    b = t.records.where("NOT success").select("variant", "k", c("id").alias("bid"))
    return R.cyclic(a, b, ["id"], ["bid"], "variant").select("id", "k")


@query("join.band", "SELECT r.id, b.band FROM records r JOIN (SELECT unnest([0, 10, 40, 100]) AS low, unnest([10, 40, 100, 1000]) AS high, unnest(['a', 'b', 'c', 'd']) AS band) b ON r.value >= b.low AND r.value < b.high")
def _(t: Tables):
    bands = t.spark.createDataFrame([(0.0, 10.0, "a"), (10.0, 40.0, "b"), (40.0, 100.0, "c"), (100.0, 1000.0, "d")], "low double, high double, band string")
    return R.band_join(t.records, bands, "value", 50.0).select("id", "band")


# --- set relations ----------------------------------------------------------------


@query("set.union", "SELECT id, 'a' AS part FROM records WHERE split = 'test' UNION ALL SELECT id, 'b' FROM records WHERE split = 'val'")
def _(t: Tables):
    part = lambda s, p: t.records.where(c("split") == s).select("id", F.lit(p).alias("part"))
    return part("test", "a").unionByName(part("val", "b")).orderBy("id")


_OVER = "SELECT a.s AS a, b.s AS b, count(*) AS n FROM (SELECT DISTINCT {0} AS x, split AS s FROM records) a JOIN (SELECT DISTINCT {0} AS x, split AS s FROM records) b ON a.x = b.x AND a.s < b.s GROUP BY 1, 2"


@query("set.intersect.count", _OVER.format("k"))
def _(t: Tables):
    return R.overlaps(t.records, "k", "split")


@query("set.intersect.hash", _OVER.format("sha256(variant || '|' || turns)"))
def _(t: Tables):
    return R.overlaps(t.records.withColumn("h", H.sha_text(c("variant"), c("turns"))), "h", "split")


@query("set.intersect.meta", f"SELECT 'k' AS field, * FROM ({_OVER.format('k')}) UNION ALL SELECT 'variant', * FROM ({_OVER.format('variant')})")
def _(t: Tables):
    of = lambda f: R.overlaps(t.records, f, "split").select(F.lit(f).alias("field"), "a", "b", "n")
    return of("k").unionByName(of("variant"))


_DISJOINT = "SELECT '{0}' AS rule, count(*) AS n_bad FROM (SELECT {0} FROM records GROUP BY {0} HAVING count(DISTINCT split) > 1)"


def _disjoint(t: Tables, keys):
    out = None
    for k in keys:
        held = t.records.groupBy(k).agg(F.countDistinct("split").alias("s"))
        row = held.agg(F.lit(k).alias("rule"), F.count_if(c("s") > 1).alias("n_bad"))
        out = row if out is None else out.unionByName(row)
    return out


@query("set.disjoint", " UNION ALL ".join(_DISJOINT.format(k) for k in ("episode", "k", "id")))
def _(t: Tables):
    return _disjoint(t, ["episode", "k", "id"])


@query("set.disjoint.four", " UNION ALL ".join(_DISJOINT.format(k) for k in ("episode", "k", "id", "variant")))
def _(t: Tables):
    return _disjoint(t, ["episode", "k", "id", "variant"])


@query("set.disjoint.scene", "SELECT count(*) AS n_bad FROM (SELECT variant, k, turns FROM records WHERE split = 'train' INTERSECT SELECT variant, k, turns FROM records WHERE split = 'test')")
def _(t: Tables):
    of = lambda s: t.records.where(c("split") == s).select("variant", "k", "turns")
    return of("train").intersect(of("test")).agg(F.count("*").alias("n_bad"))


@query("set.except", "SELECT id FROM (SELECT doc_id AS id FROM labels EXCEPT ALL SELECT id FROM cands WHERE n > 500) ORDER BY id LIMIT 3")
def _(t: Tables):
    missing = t.labels.select(c("doc_id").alias("id")).exceptAll(t.cands.where("n > 500").select("id"))
    return missing.orderBy("id").limit(3)
