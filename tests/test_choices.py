"""Ranks by ranges, folds, quotas, hashes of images, clusters and drawn points, against plain Python."""

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import dedup as D
from millrace.operators import project as P
from millrace.operators import window as W

c = F.col


def tag(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def test_ranks_over_many_ranges(spark):
    """Ranges of seven ids, a group with most of the rows, a null group, ties."""
    rng = random.Random(1)
    rows = [(i // 2, rng.choice(["a", "a", "a", "b", None])) for i in range(400)] + [(-5, "b"), (10_000, "b")]
    df = spark.createDataFrame(rows, "id long, g string").withColumn("row", F.monotonically_increasing_id())
    got = W.ranked(df, ["g"], ["id", "row"], W.id_range(c("id"), 7), "at", "n").collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append(r)
    assert len(got) == len(rows)
    for g, own in by.items():
        assert [r.at for r in sorted(own, key=lambda r: (r.id, r.row))] == list(range(len(own))) and {r.n for r in own} == {len(own)}
    assert W.ranked(df.limit(0), ["g"], ["id"], W.id_range(c("id"))).count() == 0


def test_hash_ranks(spark):
    df = spark.range(300).select(c("id"), (c("id") % 3 == 0).alias("g"))
    got = {r.id: r.place for r in W.hash_ranked(df, ["g"], "s", "id").collect()}
    for g in (True, False):
        own = sorted((i for i in range(300) if (i % 3 == 0) == g), key=lambda i: (tag("s", i), i))
        assert [got[i] for i in own] == list(range(len(own)))


def test_no_window_sees_a_whole_class(spark):
    """The plans rank a range of a class at most; only counts of ranges are summed by class."""
    df = spark.range(100).select(c("id"), (c("id") % 2).alias("g"))
    plans = [W.stride(df, "g", "id", 3), W.holdout(df, "g", 0.1, "s", "id"), W.balanced(df, "g", ["a", "b"], "s", "id"), W.evenly_spread(df, "g", "id", 4), P.expand_release(df.withColumn("g", c("g").cast("string")), "g", "id", {"0": 1, "1": 2})]
    for plan in plans:
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        for line in text.splitlines():
            if "Window [" in line:
                assert "row_number" not in line or "__span" in line, line


def slow_fold(groups, seed, shares, weights, penalty):
    """Each split's deviation recomputed from nothing at every step."""
    totals = Counter()
    for _, f in groups:
        totals.update(f)
    held = {s: [] for s in shares}

    def deviation(split, members):
        have = Counter()
        for f in members:
            have.update(f)
        return sum(weights[k[0]] * abs(have[k] - totals[k] * shares[split]) / max(1.0, totals[k] * shares[split]) for k in totals)

    out = []
    for key, f in sorted(groups, key=lambda g: (-g[1]["total", "*"], tag(seed, g[0], "component_order"))):
        best = None
        for s in shares:
            want = totals["total", "*"] * shares[s]
            size = sum(m["total", "*"] for m in held[s]) + f["total", "*"]
            cost = deviation(s, [*held[s], f]) - deviation(s, held[s]) + penalty * (max(0.0, size - want) / max(1.0, want)) ** 2
            found = (round(cost, 9), tag(seed, key, s, "split_tie"), s)
            best = min(best or found, found)
        held[best[2]].append(f)
        out.append((key, best[2]))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_greedy_fold(seed):
    rng = random.Random(seed)
    groups = []
    for i in range(40):
        f = Counter()
        for _ in range(rng.randint(1, 12)):
            f["total", "*"] += 1
            f["category", rng.choice("ab")] += 1
            f["software", rng.choice("wxyz")] += 1
        groups.append((i, f))
    assert W.fold_greedy(groups, seed) == slow_fold(groups, seed, W.SHARES, W.FEATURES, 30.0)


def slow_quotas(rows, quotas, per_image, icon_share):
    """Every pick looks at every row."""
    left, chosen = {s: dict(q) for s, q in quotas.items()}, {}
    info = {r[1]: r for r in rows}

    def pick(split, category, icons):
        home = {info[k][2]: s for k, s in chosen.items()}
        full = Counter(info[k][3] for k in chosen)
        used = Counter(info[k][4] for k, s in chosen.items() if s == split)
        free = [r for r in rows if r[5] == category and (r[6] or not icons) and r[1] not in chosen and full[r[3]] < per_image and home.get(r[2], split) == split]
        if not free:
            return False
        best = min(free, key=lambda r: (used[r[4]], r[4], r[0], r[1]))
        chosen[best[1]] = split
        left[split][category] -= 1
        return True

    need = min(sum(r[6] for r in rows if r[5] == "direct"), math.ceil(icon_share * sum(q["direct"] for q in quotas.values())))
    while need:
        before = need
        for s in quotas:
            if need and left[s]["direct"] and pick(s, "direct", True):
                need -= 1
        if before == need:
            return None
    for s, category in itertools.product(quotas, ("direct", "functional")):
        while left[s][category]:
            if not pick(s, category, False):
                return None
    return chosen


@pytest.mark.parametrize("seed", range(8))
def test_quotas(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([60, 200])
    images = [rng.randint(0, n // 2) for _ in range(n)]
    rows = [(tag("q", i), i, images[i] // 2, images[i], rng.choice("uvwx"), rng.choice(["direct", "functional"]), rng.random() < 0.2) for i in range(n)]
    quotas = {"train": {"direct": 8, "functional": 6}, "val": {"direct": 3, "functional": 2}, "test": {"direct": 2, "functional": 2}}
    want = slow_quotas(rows, quotas, 2, 0.3)
    if want is None:
        with pytest.raises(ValueError):
            W.fill_quotas(rows, quotas, 2, 0.3)
        return
    assert dict(W.fill_quotas(rows, quotas, 2, 0.3)) == want
    group, images = {}, Counter()
    for k, s in want.items():
        assert group.setdefault(rows[k][2], s) == s
        images[rows[k][3]] += 1
    assert max(images.values()) <= 2
    if seed < 4:  # what Spark hands over is enough
        df = spark.createDataFrame([r[1:] for r in rows], "id long, leak long, image long, software string, category string, icon boolean")
        pool = W.quota_pool(df, quotas, W.hash_order("q", "id"), 2).select("order", "id", "leak", "image", "software", "category", "icon")
        assert dict(W.fill_quotas([tuple(r) for r in pool.collect()], quotas, 2, 0.3)) == want


def test_quotas_that_cannot_be_filled():
    with pytest.raises(ValueError):
        W.fill_quotas([("a", 1, 1, 1, "s", "direct", False)], {"train": {"direct": 2}})
    assert W.fill_quotas([], {"train": {"direct": 0}}) == []


def test_groups_are_folded_into_splits():
    groups = [(i, 5, [i, 100 + i // 2], i % 9 == 0) for i in range(30)]
    out = dict(W.fold_groups(groups, "s"))
    assert len(out) == 30 and all(out[i] in ("test", "excluded") for i in range(0, 30, 9))
    seen = {}
    for i, _, hashes, _ in groups:
        if out[i] != "excluded":
            for h in hashes:
                assert seen.setdefault(h, out[i]) == out[i]  # no hash is in two splits
    rows = Counter()
    for i, n, _, _ in groups:
        rows[out[i]] += n
    assert rows["test"] >= 15 and rows["val"] >= 15 and rows["train"] > rows["test"]
    # A group whose hashes are in two splits belongs to neither.
    order = sorted("abc", key=lambda k: tag("s", k))
    clash = [(order[0], 1, [1], False), (order[1], 1, [2], False), (order[2], 8, [1, 2], False)]
    assert dict(W.fold_groups(clash, "s")) == {order[0]: "test", order[1]: "val", order[2]: "excluded"}
    assert W.fold_groups([], "s") == [] and W.fold_groups([("x", 2, [], False)], "s") == [("x", "train")]


def test_targets_are_filled_evenly(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 0, 0, 1, 2]), rng.randint(0, 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, target long, pool long")
    left = {t: sorted((r for r in rows if r[1] == t), key=lambda r: (r[2], tag("s", r[0]))) for t in range(3)}
    want, filled = [], Counter()
    for _ in range(40):
        t = min((t for t in left if left[t]), key=lambda t: (filled[t], t), default=None)
        if t is None:
            break
        want.append(left[t].pop(0)[0])
        filled[t] += 1
    got = [r.id for r in W.least_filled(df, "target", 3, "pool", "id", "s", 40).collect()]
    assert sorted(got) == sorted(want)
    with pytest.raises(ValueError, match=r"\[3\]"):
        W.least_filled(df, "target", 4, "pool", "id", "s", 40)


def test_hash_of_an_image(spark):
    rng = np.random.default_rng(0)
    images = [rng.integers(0, 256, (32, 32), dtype=np.uint8) for _ in range(3)]
    df = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(images)] + [(8, None), (9, bytearray(5))], "id long, p binary")
    got = {r.id: r.v for r in df.select("id", D.perceptual_hash("p").alias("v")).collect()}
    for n, x in enumerate(images):
        f = []
        for u, v in itertools.product(range(8), range(8)):
            s = sum(int(x[i, j]) * math.cos(math.pi / 32 * (i + 0.5) * u) * math.cos(math.pi / 32 * (j + 0.5) * v) for i in range(32) for j in range(32))
            f.append(s * math.sqrt((1 if u == 0 else 2) / 32) * math.sqrt((1 if v == 0 else 2) / 32))
        middle = sorted(f[1:])[31]
        assert got[n] == "".join("1" if y > middle else "0" for y in f)
    assert got[8] is None and got[9] is None


def test_clusters_of_one_hash(spark):
    """All rows of the query's kind, against clusters made one by one."""
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, 1.0, 2.0]) + rng.choice([0.0, 0.3, 0.6]) for _ in range(2)]) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumn("b", D.sign_hash(c("v")))
    bucket = {r.id: r.b for r in df.collect()}
    made, want = {}, {}
    for i, v in rows:
        own = made.setdefault(bucket[i], [])
        home = next((m for m in own if all(max(abs(x - y) for x, y in zip(v, o)) <= 0.5 for o in m[1])), None)
        if home is None:
            home = (i, [])
            own.append(home)
        home[1].append(v)
        want[i] = home[0]
    assert {r.id: r.cluster for r in D.greedy_clusters(df, "b", "id", "v", 0.5).collect()} == want


def test_drawn_points_keep_their_distance(spark, small):
    from millrace.plans.everything import QUERIES

    by = {}
    for r in QUERIES["gen.positions"](spark, small).collect():
        by.setdefault(r.id, {})[r.j] = (r.x, r.y)
    for pts in list(by.values())[:200]:
        assert sorted(pts) == list(range(8))
        assert all(math.dist(a, b) >= 90 and 40 <= a[0] <= 1240 and 40 <= a[1] <= 680 for a, b in itertools.combinations(pts.values(), 2))
    rng, want = np.random.default_rng(min(by)), []
    while len(want) < 8:
        q = rng.uniform((40, 40), (1240, 680))
        if all(math.dist(q, o) >= 90 for o in want):
            want.append(tuple(q))
    assert [by[min(by)][j] for j in range(8)] == want


def test_tours_of_any_length(spark):
    rng = random.Random(6)
    tours = [[[rng.randint(0, 9), rng.randint(0, 9)] for _ in range(n)] for n in (0, 1, 2, 5, 5, 10)] + [None]
    df = spark.createDataFrame(list(enumerate(tours)), "id long, p array<array<long>>")
    got = {r.id: r.t for r in df.select("id", W.nearest_tour("p").alias("t")).collect()}
    for i, p in enumerate(tours):
        want = None if p is None else []
        left = set(range(len(p or [])))
        while left:
            at = min(left, key=lambda k: (sum((a - b) ** 2 for a, b in zip(p[k], p[want[-1]])), k)) if want else 0
            left.discard(at)
            want.append(at)
        assert got[i] == want


def test_last_images_of_each_action(spark):
    rows = [(1, i, k) for i, k in enumerate("oaooaoaao")] + [(2, 0, "a")]
    kinds = {"o": "observation", "a": "action"}
    df = spark.createDataFrame([(i, p, kinds[k]) for i, p, k in rows], "id long, pos long, kind string")
    for n in (1, 2, 3):
        got = {(r.id, r.pos): (list(r.images), list(r.responses)) for r in P.history(df, images=n).collect()}
        for i, p, k in rows:
            if k == "a":
                before = [(q, x) for j, q, x in rows if j == i and q < p]
                assert got[i, p] == ([q for q, x in before if x == "o"][-n:], [q for q, x in before if x == "a"])
