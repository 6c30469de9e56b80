"""Queries of aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geometry import score
from ..functions.hashing import sha_text
from ..operators import aggregate as G
from ..operators import validate as V
from .catalog import Tables, query

c = F.col


@query("agg.count_by", "SELECT x.variant, coalesce(n, 0) AS n FROM (SELECT unnest(['view', 'click', 'error', 'none']) AS variant) x LEFT JOIN (SELECT variant, count(*) AS n FROM records GROUP BY 1) y ON x.variant = y.variant")
def _(t: Tables):
    classes = t.spark.createDataFrame([(v,) for v in ("view", "click", "error", "none")], "variant string")
    return G.count_by(t.records, ["variant"], classes)


@query("agg.count_actions", "SELECT role, kind, count(*) AS n FROM steps GROUP BY 1, 2")
def _(t: Tables):
    nested = t.steps.groupBy("id").agg(F.collect_list(F.struct("role", "kind")).alias("s"))
    return nested.select(F.explode("s").alias("s")).groupBy("s.role", "s.kind").agg(F.count("*").alias("n"))


@query("agg.count_actions.flat", "SELECT kind, count(*) AS n FROM (SELECT kind FROM steps UNION ALL SELECT variant FROM records) GROUP BY 1")
def _(t: Tables):
    return G.count_by(t.steps.select("kind").unionByName(t.records.select(c("variant").alias("kind"))), ["kind"])


@query("agg.map_merge", "SELECT key, CAST(sum(n) AS BIGINT) AS n FROM (SELECT variant AS key, k AS n FROM records UNION ALL SELECT split, turns FROM records) GROUP BY 1")
def _(t: Tables):
    return G.merge_maps(t.records.select(F.create_map(c("variant"), c("k"), c("split"), c("turns")).alias("m")), "m")


@query("agg.success", "SELECT variant, count(*) AS n, count(*) FILTER (WHERE success) AS successes, round(avg(success::INT), 6) AS rate, count(*) FILTER (WHERE value < 1) AS infra FROM records GROUP BY ROLLUP (variant)")
def _(t: Tables):
    return G.success_table(t.records, "variant", "success", c("value") < 1)


@query("agg.success.terminal", "SELECT variant, split, count(*) AS n FROM records GROUP BY ROLLUP (variant, split)")
def _(t: Tables):
    return t.records.rollup("variant", "split").agg(F.count("*").alias("n"))


@query("agg.checkpoint", "SELECT episode, count(*) AS n, round(avg(success::INT), 6) AS rate, round(avg(value), 6) AS mean_value, round(avg(turns), 6) AS mean_turns, string_agg(DISTINCT variant, ',' ORDER BY variant) AS terminals FROM records GROUP BY 1")
def _(t: Tables):
    mean = lambda x: F.round(F.avg(x), 6)
    return t.records.groupBy("episode").agg(F.count("*").alias("n"), mean(c("success").cast("int")).alias("rate"), mean("value").alias("mean_value"), mean("turns").alias("mean_turns"), F.array_join(F.array_sort(F.collect_set("variant")), ",").alias("terminals"))


@query("agg.sweep", "SELECT k, rate, coalesce(rate >= lag(rate) OVER (ORDER BY k), true) AS rises FROM (SELECT k // 10 AS k, round(avg(success::INT), 6) AS rate FROM records GROUP BY 1)")
def _(t: Tables):
    rows = t.records.groupBy(F.floor(c("k") / 10).alias("k")).agg(F.round(F.avg(c("success").cast("int")), 6).alias("rate"))
    return rows.withColumn("rises", F.coalesce(c("rate") >= F.lag("rate").over(Window.orderBy("k")), F.lit(True)))


@query("agg.frontier", "SELECT variant, n, 2000 - n AS missing, CASE WHEN n > 0 THEN round(s / n, 6) END AS observed, CASE WHEN n >= 2000 THEN round(s / n, 6) END AS formal FROM (SELECT variant, count(*) AS n, count(*) FILTER (WHERE success) AS s FROM records GROUP BY 1)")
def _(t: Tables):
    g = t.records.groupBy("variant").agg(F.count("*").alias("n"), F.count_if("success").alias("s"))
    rate = F.round(F.try_divide("s", "n"), 6)
    return g.select("variant", "n", (2000 - c("n")).alias("missing"), rate.alias("observed"), F.when(c("n") >= 2000, rate).alias("formal"))


@query("agg.phase", "SELECT count(*) AS cases, CAST(sum(turns) AS BIGINT) AS calls, round(count(*) * 3600.0 / 1800, 6)::DOUBLE AS cases_hour, round(sum(turns) / 1800.0, 6)::DOUBLE AS calls_s, round(avg(value), 6) AS latency FROM records")
def _(t: Tables):
    wall = 1800.0
    return t.records.agg(F.count("*").alias("cases"), F.sum("turns").alias("calls"), F.round(F.count("*") * 3600 / wall, 6).alias("cases_hour"), F.round(F.sum("turns") / wall, 6).alias("calls_s"), F.round(F.avg("value"), 6).alias("latency"))


_SCORED = "(SELECT variant, CASE WHEN px > 1000 THEN 'wrong_format' WHEN px * w / 1000 BETWEEN x1 AND x2 AND py * h / 1000 BETWEEN y1 AND y2 THEN 'correct' ELSE 'wrong' END AS v FROM boxes)"


def _scored(t: Tables):
    return t.boxes.select("variant", score(*[c(n) for n in ("px", "py", "w", "h", "x1", "y1", "x2", "y2")]).alias("v"))


@query("agg.accuracy", f"SELECT variant, count(*) FILTER (WHERE v = 'correct') AS correct, count(*) FILTER (WHERE v = 'wrong') AS wrong, count(*) FILTER (WHERE v = 'wrong_format') AS wrong_format, round(count(*) FILTER (WHERE v = 'correct') / count(*), 6) AS accuracy, round(count(*) FILTER (WHERE v <> 'wrong_format') / count(*), 6) AS parse_rate FROM {_SCORED} GROUP BY 1")
def _(t: Tables):
    n = lambda x: F.count_if(c("v") == x)
    return _scored(t).groupBy("variant").agg(n("correct").alias("correct"), n("wrong").alias("wrong"), n("wrong_format").alias("wrong_format"), F.round(n("correct") / F.count("*"), 6).alias("accuracy"), F.round((n("correct") + n("wrong")) / F.count("*"), 6).alias("parse_rate"))


@query("agg.bench", f"SELECT variant, nullif(count(*) FILTER (WHERE v = 'correct'), 0) AS correct, nullif(count(*) FILTER (WHERE v = 'wrong'), 0) AS wrong, nullif(count(*) FILTER (WHERE v = 'wrong_format'), 0) AS wrong_format FROM {_SCORED} GROUP BY 1")
def _(t: Tables):
    return _scored(t).groupBy("variant").pivot("v", ["correct", "wrong", "wrong_format"]).count()


@query("agg.median_then_corr", "SELECT count(*) AS episodes, round(corr(m, g), 6) AS with_gain, round(corr(m, 1 / g), 6) AS with_inverse FROM (SELECT episode, median(value) AS m, min((episode % 7 + 1) / 4) AS g FROM records GROUP BY 1)")
def _(t: Tables):
    return G.median_then_corr(t.records.withColumn("gain", (c("episode") % 7 + 1) / 4), "episode", "value", "gain")


@query("agg.pearson", "SELECT variant, CASE WHEN count(*) > 1 AND stddev_samp(value) > 0 AND stddev_samp(x) > 0 THEN round(corr(value, x), 6) END AS r FROM (SELECT variant, value, CASE WHEN variant = 'view' THEN 1 ELSE k END AS x FROM records) GROUP BY 1")
def _(t: Tables):
    x = F.when(c("variant") == "view", F.lit(1).cast("long")).otherwise(c("k"))
    return t.records.withColumn("x", x).groupBy("variant").agg(F.round(G.pearson(c("value"), c("x")), 6).alias("r"))


@query("agg.cohort", """WITH m AS (SELECT episode, median(value) AS v, median(CASE WHEN k > 95 AND success THEN value END) AS f FROM records WHERE variant = 'view' GROUP BY 1)
SELECT count(*) AS episodes, count(f) AS filtered, count(*) - count(f) AS uncomputed, round(avg(v), 6) AS mean_all, round(avg(f), 6) AS mean_filtered FROM m""")
def _(t: Tables):
    m = t.records.where("variant = 'view'").groupBy("episode").agg(F.median("value").alias("v"), F.median(F.when((c("k") > 95) & c("success"), c("value"))).alias("f"))
    return m.agg(F.count("*").alias("episodes"), F.count("f").alias("filtered"), (F.count("*") - F.count("f")).alias("uncomputed"), F.round(F.avg("v"), 6).alias("mean_all"), F.round(F.avg("f"), 6).alias("mean_filtered"))


@query("agg.hhi", "SELECT round(sum(n * n) / (sum(n) * sum(n)), 9) AS hhi, round(max(n) / sum(n), 9) AS largest, count(*) AS \"values\" FROM (SELECT platform, count(*)::DOUBLE AS n FROM cands GROUP BY 1)")
def _(t: Tables):
    return G.concentration(t.cands, "platform")


@query("agg.top_k", "SELECT k, n FROM (SELECT k, count(*) AS n, min(id) AS f FROM records GROUP BY 1) ORDER BY n DESC, f, k LIMIT 20")
def _(t: Tables):
    return G.top_k(t.records, "k", "id", 20)


@query("agg.distinct_sets", "SELECT episode, string_agg(DISTINCT substr(sha256(variant || '|' || split), 1, 6), ',' ORDER BY substr(sha256(variant || '|' || split), 1, 6)) AS hashes FROM records GROUP BY 1")
def _(t: Tables):
    h = F.substring(sha_text(c("variant"), c("split")), 1, 6)
    return t.records.groupBy("episode").agg(F.array_join(F.array_sort(F.collect_set(h)), ",").alias("hashes"))


@query("agg.group_split_sets", "SELECT k, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM records GROUP BY 1 HAVING count(DISTINCT split) > 1")
def _(t: Tables):
    g = t.records.groupBy("k").agg(F.array_sort(F.collect_set("split")).alias("s"))
    return g.where(F.size("s") > 1).select("k", F.array_join("s", ",").alias("splits"))


@query("agg.grpo_advantage", "SELECT id, round(CASE WHEN count(*) OVER w = 1 THEN value ELSE (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-6) END, 5) AS v FROM records WINDOW w AS (PARTITION BY episode, variant, k // 10)")
def _(t: Tables):
    rows = t.records.withColumn("g", F.struct("episode", "variant", F.floor(c("k") / 10)))
    return rows.select("id", F.round(G.advantages(rows, "g", "value"), 5).alias("v"))


@query("agg.step_weight", "SELECT id, pos, round((kind = 'action')::INT / count(*) OVER (PARTITION BY id), 9) AS w FROM steps")
def _(t: Tables):
    mask = (c("kind") == "action").cast("int")
    return t.steps.select("id", "pos", F.round(mask * G.step_weights("id"), 9).alias("w"))


@query("agg.step_weight.ground", "SELECT id, round(1.0 / count(*) OVER (PARTITION BY episode), 9)::DOUBLE AS w FROM records")
def _(t: Tables):
    key = F.regexp_extract(F.concat_ws("_", F.lit("ep"), "episode", "id"), r"^(.*)_[^_]*$", 1)
    return t.records.withColumn("s", key).select("id", F.round(G.step_weights("s"), 9).alias("w"))


@query("agg.step_validate", "SELECT id, min(pos) = 0 AND max(pos) = count(*) - 1 AND count(DISTINCT pos) = count(*) AND count(*) % 2 = 1 AS ok FROM steps GROUP BY 1")
def _(t: Tables):
    """The last step is rewarded where it has an even place (a second one is rewarded nowhere)."""
    last = c("pos") == F.max("pos").over(Window.partitionBy("id"))
    rows = t.steps.withColumn("reward", F.when(last & (c("pos") % 2 == 0), 1.0))
    return G.step_gate(rows, "id", "pos", "reward")


@query("agg.max_run", """SELECT episode, max(n) AS longest FROM (SELECT episode, isle, count(*) AS n FROM (SELECT episode, sum(new) OVER (PARTITION BY episode ORDER BY id) AS isle FROM (
  SELECT episode, id, (variant IS DISTINCT FROM lag(variant) OVER (PARTITION BY episode ORDER BY id))::INT AS new FROM records)) GROUP BY 1, 2) GROUP BY 1""")
def _(t: Tables):
    return G.max_runs(t.records, "episode", "id", "variant")


@query("agg.transitions", "SELECT episode, count(*) FILTER (WHERE p IS NOT NULL AND variant <> p) AS changes FROM (SELECT episode, variant, lag(variant) OVER (PARTITION BY episode ORDER BY id) AS p FROM records) GROUP BY 1")
def _(t: Tables):
    return G.transitions(t.records, "episode", "id", "variant")


@query("agg.ordered_hash", "SELECT episode, sha256(string_agg(id::VARCHAR, chr(10) ORDER BY id) || chr(10)) AS digest FROM records GROUP BY 1")
def _(t: Tables):
    return G.ordered_hash(t.records, "episode", "id", "id")


@query("agg.dup_counts", "SELECT count(*) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS excess FROM (SELECT text, count(*) AS n FROM cands GROUP BY 1 HAVING count(*) > 1)")
def _(t: Tables):
    g = t.cands.groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.count("*").alias("groups"), F.coalesce(F.sum(c("n") - 1), F.lit(0).cast("long")).alias("excess"))


@query("agg.quality_issues", "SELECT split, issue, count(*) AS n FROM (SELECT split, unnest(list_filter([CASE WHEN k > 90 THEN 'high' END, CASE WHEN turns = 1 THEN 'short' END, CASE WHEN value > 200 THEN 'slow' END], lambda x: x IS NOT NULL)) AS issue FROM records) GROUP BY 1, 2")
def _(t: Tables):
    issues = F.array_compact(F.array(F.when(c("k") > 90, "high"), F.when(c("turns") == 1, "short"), F.when(c("value") > 200, "slow")))
    return t.records.select("split", F.explode(issues).alias("issue")).groupBy("split", "issue").agg(F.count("*").alias("n"))


@query("agg.dataset_validate", "SELECT 'negative' AS rule, count(*) FILTER (WHERE value < 1) AS n_bad FROM records UNION ALL SELECT 'turns', count(*) FILTER (WHERE turns > 18) FROM records UNION ALL SELECT 'pair', count(*) FROM (SELECT episode FROM records GROUP BY 1 HAVING count(DISTINCT variant) < 5) UNION ALL SELECT 'unlabelled', count(*) FROM cands WHERE id NOT IN (SELECT doc_id FROM labels)")
def _(t: Tables):
    rows = V.gate(t.records, [("negative", c("value") < 1), ("turns", c("turns") > 18)])
    pair = t.records.groupBy("episode").agg(F.countDistinct("variant").alias("d")).agg(F.lit("pair").alias("rule"), F.count_if(c("d") < 5).alias("n_bad"))
    free = t.cands.join(t.labels.select(c("doc_id").alias("id")), "id", "left_anti").agg(F.lit("unlabelled").alias("rule"), F.count("*").alias("n_bad"))
    return rows.unionByName(pair).unionByName(free)


@query("agg.plan", "SELECT variant, split, count(*) FILTER (WHERE k % 3 = 0) AS reusable, count(*) FILTER (WHERE k % 3 > 0) AS to_do FROM records GROUP BY CUBE (variant, split)")
def _(t: Tables):
    done = t.records.where("k % 3 = 0").select("id", F.lit(True).alias("done"))
    j = t.records.join(done, "id", "left")
    return j.cube("variant", "split").agg(F.count("done").alias("reusable"), F.count_if(c("done").isNull()).alias("to_do"))


@query("agg.conflict_ceiling", "SELECT count(*) AS inputs, count(*) FILTER (WHERE d > 1) AS conflicts, round(sum(m) / sum(n), 9) AS ceiling FROM (SELECT k, turns, count(*) AS d, max(n) AS m, sum(n) AS n FROM (SELECT k, turns, variant, count(*) AS n FROM records GROUP BY 1, 2, 3) GROUP BY 1, 2)")
def _(t: Tables):
    return G.conflict_ceiling(t.records, ["k", "turns"], "variant")


# --- groupings, sketches and table functions -------------------------------------------


@query("agg.cube", "SELECT variant, split, grouping(variant) * 2 + grouping(split) AS level, count(*) AS n, CAST(sum(k) AS BIGINT) AS k FROM records GROUP BY CUBE (variant, split)")
def _(t: Tables):
    return t.records.cube("variant", "split").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum("k").alias("k"))


@query("agg.grouping_sets", "SELECT variant, split, success, count(*) AS n FROM records GROUP BY GROUPING SETS ((variant, split), (success), ())")
def _(t: Tables):
    sets = [[c("variant"), c("split")], [c("success")], []]
    return t.records.groupingSets(sets, "variant", "split", "success").agg(F.count("*").alias("n"))


@query("agg.approx", "SELECT variant, true AS few_off, true AS middle_off FROM records GROUP BY 1")
def _(t: Tables):
    """Sketches of each variant against what they stand for: distinct episodes within 10 %, the median's rank within 2 %."""
    near = t.records.groupBy("variant").agg(F.approx_count_distinct("episode", 0.02).alias("sketch"), F.countDistinct("episode").alias("exact"), F.percentile_approx("value", 0.5, 1000).alias("mid"), F.count("*").alias("n"))
    ranks = t.records.join(near, "variant").groupBy("variant", "sketch", "exact", "n").agg(F.count_if(c("value") < c("mid")).alias("below"), F.count_if(c("value") <= c("mid")).alias("upto"))
    few = F.abs(c("sketch") - c("exact")) <= 0.1 * c("exact")
    return ranks.select("variant", few.alias("few_off"), ((c("below") <= 0.52 * c("n")) & (c("upto") >= 0.48 * c("n"))).alias("middle_off"))


@query("udtf.lines", "SELECT id, i - 1 AS line, len(string_split(text, chr(10))[i]) AS n FROM (SELECT id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM cands WHERE text IS NOT NULL)")
def _(t: Tables):
    """A table function that gives a row for each line of a text."""

    class Lines:
        def eval(self, text: str):
            for i, line in enumerate(text.split("\n")):
                yield i, len(line)

    t.spark.udtf.register("millrace_lines", F.udtf(Lines, returnType="line long, n long"))
    t.cands.where("text IS NOT NULL").createOrReplaceTempView("millrace_texts")
    return t.spark.sql("SELECT id, line, f.n FROM millrace_texts, LATERAL millrace_lines(text) f")
