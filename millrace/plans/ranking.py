"""Queries of windows, ranking, sampling, quotas and schedules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import window as W
from .catalog import Tables, query

c = F.col

_ACTS = "(SELECT id, count(*) FILTER (WHERE kind = 'action') AS n FROM steps GROUP BY 1)"


def _acts(t: Tables):
    return t.steps.groupBy("id").agg(F.count_if(c("kind") == "action").alias("n"))


@query("win.sliding_context", f"SELECT id, stop, CASE WHEN stop <= 3 THEN 0 ELSE stop - 1 END AS targets_from, greatest(0, stop - 3) AS images_from FROM (SELECT id, unnest(range(least(3, n), n + 1)) AS stop FROM {_ACTS} WHERE n > 0)")
def _(t: Tables):
    return W.sliding(_acts(t), "id", "n").select("id", "stop", "targets_from", "images_from")


@query("win.sliding_context.norm", f"SELECT w.id, stop, CAST(sum(s.n) AS BIGINT) AS tokens FROM (SELECT id, unnest(range(least(3, n), n + 1)) AS stop FROM {_ACTS} WHERE n > 0) w JOIN (SELECT id, n, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS i FROM steps WHERE kind = 'action') s ON s.id = w.id AND i >= stop - 3 AND i < stop GROUP BY 1, 2")
def _(t: Tables):
    acts = t.steps.where("kind = 'action'").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "n"))), lambda x: x.n).alias("sizes"))
    w = W.sliding(acts.withColumn("n", F.size("sizes").cast("long")), "id", "n")
    kept = F.slice("sizes", (c("images_from") + 1).cast("int"), F.least(c("stop"), F.lit(3)).cast("int"))
    return w.select("id", "stop", F.aggregate(kept, F.lit(0).cast("long"), lambda s, x: s + x).alias("tokens"))


@query("win.rank_stable", "SELECT id, row_number() OVER (PARTITION BY split ORDER BY sha256('7|' || split || '|' || id), id) AS nth FROM records")
def _(t: Tables):
    return W.hash_ranked(t.records, ["split"], "7", "split", "id").select("id", (c("place") + 1).alias("nth"))


_AT = "SELECT id, i FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY variant) AS n FROM records) JOIN (SELECT unnest(range(0, 7)) AS j) ON i = {}"


@query("win.evenly_spread", _AT.format("floor((j + 0.5) * n / 7)"))
def _(t: Tables):
    return W.evenly_spread(t.records, "variant", "id", 7).select("id", "i")


@query("win.spread_selection", _AT.format("j * n // 7"))
def _(t: Tables):
    return W.spread(t.records, "variant", "id", 7).select("id", "i")


@query("win.linspace", _AT.format("round_even(j * (n - 1) / 6, 0)"))
def _(t: Tables):
    return W.linspaced(t.records, "variant", "id", 7).select("id", "i")


@query("win.stride_shard", "SELECT id, (row_number() OVER (PARTITION BY variant ORDER BY id) - 1) % 8 AS shard FROM records")
def _(t: Tables):
    return W.stride(t.records, "variant", "id", 8).select("id", "shard")


@query("win.interleave", "SELECT id, j, variant FROM (SELECT id, variant, (row_number() OVER (PARTITION BY variant ORDER BY id) - 1) // 4 AS j, (row_number() OVER (PARTITION BY variant ORDER BY id) - 1) % 4 AS r FROM records) WHERE r = 0")
def _(t: Tables):
    return W.ranked(t.records, ["variant"], ["id"], W.id_range(c("id")), "i").where("i % 4 = 0").select("id", F.floor(c("i") / 4).alias("j"), "variant").orderBy("j", "variant")


@query("win.shuffle.seeded", "SELECT id, row_number() OVER (PARTITION BY variant ORDER BY sha256('42|a|' || id), id) AS place FROM records")
def _(t: Tables):
    rows = t.records.withColumn("h", H.sha_text("42", "a", c("id")))
    return W.ranked(rows, ["variant"], ["h", "id"], W.hash_range(c("h"))).select("id", (c("place") + 1).alias("place"))


@query("win.dedup_first", "SELECT episode, id FROM (SELECT episode, id, row_number() OVER (PARTITION BY episode ORDER BY sha256('3|' || id), id) AS n FROM records) WHERE n = 1")
def _(t: Tables):
    return W.first_by(t.records, ["episode"], [W.hash_order("3", "id"), "id"]).select("episode", "id")


@query("win.dedup_min", "SELECT episode, variant, k, id FROM (SELECT *, row_number() OVER (PARTITION BY episode, variant ORDER BY k, turns, id) AS n FROM records) WHERE n = 1")
def _(t: Tables):
    g = t.records.groupBy("episode", "variant").agg(F.min(F.struct("k", "turns", "id")).alias("m"))
    return g.select("episode", "variant", "m.k", "m.id")


@query("win.choose_one", "SELECT episode, id FROM (SELECT episode, id, row_number() OVER (PARTITION BY episode ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY episode) AS n FROM records) WHERE i = CAST(('0x' || substr(sha256('9|' || episode), 1, 16))::UBIGINT % n::UBIGINT AS BIGINT)")
def _(t: Tables):
    w = Window.partitionBy("episode")
    rows = t.records.withColumn("i", F.row_number().over(w.orderBy("id")) - 1).withColumn("n", F.count("*").over(w))
    return rows.where(c("i") == (H.stable_int("9", c("episode")) % c("n")).cast("long")).select("episode", "id")


@query("win.limit_hash", "SELECT id FROM records ORDER BY sha256('5|' || id), id LIMIT 100")
def _(t: Tables):
    return t.records.orderBy(W.hash_order("5", "id"), "id").limit(100).select("id")


_LR = """WITH n AS (SELECT platform, count(*) AS n FROM cands GROUP BY 1), r AS (SELECT *, n * 100 / sum(n) OVER () AS raw FROM n), f AS (SELECT *, floor(raw) AS low, row_number() OVER (ORDER BY raw - floor(raw) DESC, platform) AS nth, 100 - sum(floor(raw)) OVER () AS rest FROM r)
SELECT platform, CAST({} AS BIGINT) AS quota FROM f"""


@query("win.quota.largest_remainder", """WITH n AS (SELECT platform, count(*) AS n FROM cands GROUP BY 1), r AS (SELECT *, n * 100 / sum(n) OVER () AS raw FROM n), l AS (SELECT *, least(floor(raw), 6) AS low FROM r),
f AS (SELECT *, row_number() OVER (ORDER BY low < 6 DESC, raw - low DESC, platform) AS nth, 100 - sum(low) OVER () AS rest FROM l)
SELECT platform, CAST(low + (low < 6 AND nth <= rest)::INT AS BIGINT) AS quota FROM f""")
def _(t: Tables):
    n = t.cands.groupBy("platform").agg(F.count("*").alias("n")).withColumn("cap", F.lit(6))
    return W.largest_remainder(n, "n", 100, "platform", "cap").select("platform", "quota")


@query("win.quota.proportional", _LR.format("low + (nth <= rest)::INT"))
def _(t: Tables):
    n = t.cands.groupBy("platform").agg(F.count("*").alias("n"))
    return W.largest_remainder(n, "n", 100, "platform").select("platform", "quota")


@query("win.quota.weighted", """WITH x AS (SELECT unnest(range(0, 9)) AS i), r AS (SELECT i, (5 - abs(i - 4)) * 200 / 25 AS raw, abs(i - 4) AS d FROM x), f AS (SELECT *, row_number() OVER (ORDER BY raw - floor(raw) DESC, d, i) AS nth, 200 - sum(floor(raw)) OVER () AS rest FROM r)
SELECT i, CAST(floor(raw) + (nth <= rest)::INT AS BIGINT) AS quota FROM f""")
def _(t: Tables):
    x = t.spark.range(9).select(c("id").alias("i"), (5 - F.abs(c("id") - 4)).alias("w"), (F.abs(c("id") - 4) * 100 + c("id")).alias("o"))
    return W.largest_remainder(x, "w", 200, "o").select("i", "quota")


@query("win.diverse_round_robin", "SELECT id, category, turn FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY turn, platform) AS nth FROM (SELECT id, category, platform, row_number() OVER (PARTITION BY category, platform ORDER BY sha256('1|' || id), id) AS turn FROM cands)) WHERE nth <= 30")
def _(t: Tables):
    return W.round_robin(t.cands, "category", "platform", "1", "id", 30).select("id", "category", "turn")


@query("win.platform_cap", "SELECT id FROM (SELECT id, platform, row_number() OVER (PARTITION BY platform ORDER BY sha256('1|' || id), id) AS n FROM cands) WHERE n <= 5")
def _(t: Tables):
    """The global cap of a diverse selection: at most five rows of a platform."""
    return W.first_by(t.cands, ["platform"], [W.hash_order("1", "id"), "id"], 5).select("id")


@query("win.pool_validate", "SELECT id FROM (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY h, id) AS n FROM (SELECT id, category, n AS size, sha256('2|' || id) AS h, row_number() OVER (PARTITION BY category ORDER BY sha256('2|' || id), id) AS p FROM cands) WHERE p <= 40 AND size > 500) WHERE n <= 10")
def _(t: Tables):
    return W.capped_pool(t.cands, "category", 10, 4, c("n") > 500, "2", "id").select("id")


def _fold(t: Tables, key):
    """Groups of a small fixed number, with their sizes and features, assigned whole."""
    g = t.cands.groupBy(key.alias("g"), "category").agg(F.count("*").alias("n"))
    groups: dict = {}
    for r in g.orderBy("g", "category").collect():
        f = groups.setdefault(r.g, {("total", "*"): 0})
        f[("total", "*")] += r.n
        f[("category", r.category)] = r.n
    rows = [(k, s, groups[k][("total", "*")]) for k, s in W.fold_greedy(list(groups.items()), 7)]
    return t.spark.createDataFrame(rows, "g long, split string, n long")


QUOTAS = {"train": {"direct": 12, "functional": 8}, "val": {"direct": 2, "functional": 2}, "test": {"direct": 2, "functional": 2}}


@query("win.greedy_quota")
def _(t: Tables):
    """Documents as targets of images: quotas of two categories by split, neighbouring images in one split, icons among the direct ones."""
    rows = t.cands.select("id", F.floor(c("id") / 6).alias("leak"), F.floor(c("id") / 3).alias("image"), c("platform").alias("software"), F.when(c("n") % 5 < 3, "direct").otherwise("functional").alias("category"), (c("n") % 10 == 0).alias("icon"))
    pool = W.quota_pool(rows, QUOTAS, W.hash_order("q", "id"), 2).select("order", "id", "leak", "image", F.coalesce("software", F.lit("")).alias("software"), "category", "icon")
    return t.spark.createDataFrame(W.fill_quotas([tuple(r) for r in pool.collect()], QUOTAS), "id long, split string")


@query("win.greedy_split")
def _(t: Tables):
    """Groups of a leakage key (the platform's hash modulo 32) folded into splits."""
    return _fold(t, F.pmod(F.xxhash64("platform"), F.lit(32)))


@query("win.target_balance", """WITH e AS (SELECT id, episode, k % 10 AS target, CASE WHEN variant = 'view' THEN 0 ELSE 1 END AS pool FROM records),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target, pool, episode ORDER BY sha256('d|' || id), id) AS nth FROM e) WHERE pool = 1 OR nth = 1)
SELECT id, target, turn FROM (SELECT id, target, row_number() OVER (PARTITION BY target ORDER BY pool, sha256('b|' || id), id) AS turn FROM d) ORDER BY turn, target LIMIT 47""")
def _(t: Tables):
    """Ten targets filled evenly, traces (of which an episode has one for a target) before episodes, and every target covered."""
    rows = t.records.select("id", "episode", (c("k") % 10).alias("target"), F.when(c("variant") == "view", 0).otherwise(1).alias("pool"))
    traces = W.first_by(rows.where("pool = 0"), ["target", "pool", "episode"], [W.hash_order("d", "id"), "id"])
    return W.least_filled(traces.unionByName(rows.where("pool = 1")), "target", 10, "pool", "id", "b", 47).select("id", "target", "turn")


@query("win.augment_cycle", "SELECT id, copy, 1 + (i * 3 + copy) % 10 AS rank FROM (SELECT id, row_number() OVER (PARTITION BY variant ORDER BY id) - 1 AS i FROM records WHERE split = 'test') JOIN (SELECT unnest(range(0, 3)) AS copy) ON true")
def _(t: Tables):
    numbered = W.ranked(t.records.where("split = 'test'"), ["variant"], ["id"], W.id_range(c("id")), "i")
    rows = numbered.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    return rows.select("id", "copy", (1 + (c("i") * 3 + c("copy")) % 10).alias("rank"))


_BAL = "SELECT id, ['a', 'b', 'c'][(row_number() OVER (PARTITION BY {} ORDER BY sha256('8|' || id), id) - 1) % 3 + 1] AS class FROM records"


@query("win.balanced_schedule", _BAL.format("split"))
def _(t: Tables):
    return W.balanced(t.records, "split", ["a", "b", "c"], "8", "id").select("id", "class")


@query("win.balanced_by_stratum", _BAL.format("k"))
def _(t: Tables):
    return W.balanced(t.records, "k", ["a", "b", "c"], "8", "id").select("id", "class")


@query("win.cond_schedule", _BAL.format("CASE WHEN value < 20 THEN 0 WHEN value < 60 THEN 1 ELSE 2 END"))
def _(t: Tables):
    band = F.when(c("value") < 20, 0).when(c("value") < 60, 1).otherwise(2)
    return W.balanced(t.records.withColumn("band", band), "band", ["a", "b", "c"], "8", "id").select("id", "class")


@query("win.nearest_neighbor", """WITH RECURSIVE p AS (SELECT id, list_transform(range(0, 10), lambda i: [(id * 37 + i * i * 131) % 1280, (id * 17 + i * 97) % 720]) AS pts FROM records),
w AS (SELECT id, pts, [0::BIGINT] AS tour FROM p UNION ALL
  SELECT id, pts, list_append(tour, list_sort(list_transform(list_filter(range(0, 10), lambda i: NOT list_contains(tour, i)),
    lambda i: [(pts[i + 1][1] - pts[tour[-1] + 1][1]) * (pts[i + 1][1] - pts[tour[-1] + 1][1]) + (pts[i + 1][2] - pts[tour[-1] + 1][2]) * (pts[i + 1][2] - pts[tour[-1] + 1][2]), i]))[1][2]) FROM w WHERE len(tour) < 10)
SELECT id, array_to_string(tour, ',') AS tour FROM w WHERE len(tour) = 10""")
def _(t: Tables):
    """A greedy tour of ten centres: each step of it is taken for a whole batch of rows."""
    pts = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.array((c("id") * 37 + i * i * 131) % 1280, (c("id") * 17 + i * 97) % 720))
    return t.records.select("id", F.array_join(W.nearest_tour(pts), ",").alias("tour"))


@query("win.split_index", "SELECT id, CASE WHEN total = 1 THEN 'smoke' WHEN n <= total // 2 THEN 'iid' ELSE 'ood' END AS part FROM (SELECT id, row_number() OVER (PARTITION BY variant ORDER BY id) AS n, count(*) OVER (PARTITION BY variant) AS total FROM records)")
def _(t: Tables):
    rows = W.ranked(t.records, ["variant"], ["id"], W.id_range(c("id")), "i", "n")
    return rows.select("id", F.when(c("n") == 1, "smoke").when(c("i") < F.floor(c("n") / 2), "iid").otherwise("ood").alias("part"))


@query("win.sensitivity", "SELECT id, CASE id % 2 WHEN 0 THEN 'low' ELSE 'high' END AS band, round_even((CASE id % 2 WHEN 0 THEN 500 ELSE 1200 END + (id * 73 + 29) % 301) / 1000, 3) AS v FROM records")
def _(t: Tables):
    low = c("id") % 2 == 0
    milli = F.when(low, 500).otherwise(1200) + (c("id") * 73 + 29) % 301  # bands of 500 to 800 and 1200 to 1500
    return t.records.select("id", F.when(low, "low").otherwise("high").alias("band"), F.bround(milli / 1000, 3).alias("v"))


@query("win.top_n_pairs", "SELECT variant, k, id FROM (SELECT *, dense_rank() OVER (PARTITION BY variant ORDER BY k) AS r FROM records) WHERE r <= 3")
def _(t: Tables):
    top = W.first_by(t.records.select("variant", "k").distinct(), ["variant"], ["k"], 3)
    return t.records.join(top, ["variant", "k"]).select("variant", "k", "id")


@query("win.holdout", "SELECT id, CASE WHEN n <= greatest(1, floor(total * 0.05)) THEN 'eval' ELSE 'train' END AS part FROM (SELECT id, row_number() OVER (PARTITION BY variant ORDER BY sha256('6|' || id), id) AS n, count(*) OVER (PARTITION BY variant) AS total FROM records)")
def _(t: Tables):
    return W.holdout(t.records, "variant", 0.05, "6", "id").select("id", "part")
