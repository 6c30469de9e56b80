"""Functions and rules on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions import geometry as G
from millrace.functions import hashing as H
from millrace.functions import jsonx as J
from millrace.functions import text as X
from millrace.operators import aggregate as agg
from millrace.operators import dedup as D
from millrace.operators import join as R
from millrace.operators import validate as V
from millrace.operators import window as W

c = F.col


def one(spark, column, schema="a int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first().v


def test_unicode_space_is_normalised(spark):
    assert one(spark, X.normalize_ws(c("a")), "a string", ("  x y\n",)) == "x y"


def test_required_text(spark):
    assert one(spark, X.required_text(c("a")), "a string", ("  ",)) is None


def test_repetition_of_short_text_is_none(spark):
    assert one(spark, X.repetition_issues(c("a")), "a string", ("one two",)) == ""
    assert one(spark, X.repetition_issues(c("a")), "a string", ("",)) == ""


def test_tool_call_round_trip(spark):
    text = J.format_tool_call(F.lit("left_click"), F.array(F.lit(3), F.lit(4)))
    assert list(one(spark, J.parse_final_click(text))) == [3, 4]


@pytest.mark.parametrize(
    "text",
    ["", "left_click", '<tool_call>{"name":"other","arguments":{"action":"left_click"}}</tool_call>', '<tool_call>{"name":"computer_use","arguments":{"action":"left_click","x":1}}</tool_call>', '<tool_call>{"name":"computer_use"</tool_call>'],
)
def test_broken_tool_calls(spark, text):
    assert one(spark, J.parse_tool_call(c("a")).isNull(), "a string", (text,))


def test_canonical_json_sorts_keys(spark):
    assert one(spark, J.canonical(c("a")), "a string", ('{"b":1.0,"a":[2,null]}',)) == '{"a":[2,null],"b":1}'
    assert one(spark, J.canonical(c("a")), "a string", ("{",)) is None


def test_stable_int_is_unsigned(spark):
    import hashlib

    want = int(hashlib.sha256(b"7|x").hexdigest()[:16], 16)
    assert int(one(spark, H.stable_int("7", c("a")), "a string", ("x",))) == want


def test_lcg(spark):
    x, want = 11, []
    for _ in range(4):
        x = (1664525 * x + 1013904223) % 2**32
        want.append(x / 2**32)
    assert one(spark, H.lcg(c("a"), 4), "a int", (11,)) == want


def test_rounding(spark):
    assert one(spark, G.half_up(F.lit(2.5))) == 3.0
    assert one(spark, G.round_coord(F.lit(2.0))) == "2"
    assert one(spark, G.wrap_deg(F.lit(190.0))) == -170.0


def test_polygon(spark):
    pts = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (10, 0), (10, 10), (5, 4), (0, 10))])
    for (x, y), want in {(5, 2): True, (5, 8): False, (0, 5): True, (11, 5): False, (10, 10): True}.items():
        assert one(spark, G.point_in_polygon(F.lit(float(x)), F.lit(float(y)), pts)) is want
    assert one(spark, G.point_in_polygon(F.lit(0.0), F.lit(0.0), F.slice(pts, 1, 2))) is None


def test_score_outcomes(spark):
    box = [F.lit(float(v)) for v in (0, 0, 10, 10)]
    size = [F.lit(1000.0), F.lit(1000.0)]
    got = [one(spark, G.score(x, F.lit(5.0), *size, *box)) for x in (F.lit(10.0), F.lit(11.0), F.lit(1001.0), F.lit(None).cast("double"))]
    assert got == ["correct", "wrong", "wrong_format", "wrong_format"]


def test_loss_mask_and_history(spark):
    m = A.loss_mask(F.array(F.lit(0), F.lit(1), F.lit(1)), F.array(F.lit(1), F.lit(1), F.lit(0)), F.lit(True))
    assert list(one(spark, m)) == [0, 1, 0]
    assert list(one(spark, A.last_n(F.array(F.lit(1)), 3))) == [1]
    assert one(spark, A.repeats(F.array().cast("array<string>"))) is False


def test_max_run_of_nothing(spark):
    assert one(spark, A.max_run(F.array().cast("array<int>"))) == 0


def test_first_reason_and_gates(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "id int, x int")
    good, bad = V.split_rejects(df, [("missing", c("x").isNull()), ("negative", c("x") < 0)])
    assert [r.id for r in good.collect()] == [1]
    assert {r.id: r.reason for r in bad.collect()} == {2: "missing", 3: "negative"}
    with pytest.raises(ValueError, match="negative: 1"):
        V.require(V.gate(df, [("negative", F.coalesce(c("x") < 0, F.lit(False)))]))


def test_bbox_reasons(spark):
    args = lambda *v: [F.lit(x).cast("double") for x in v]
    reason = lambda *v: one(spark, V.bbox_reason(*args(*v), F.lit(100.0), F.lit(100.0)))
    got = [reason(1, 1, 41, 31), reason(None, 1, 2, 2), reason(math.nan, 1, 2, 2), reason(5, 5, 5, 9), reason(-1, 0, 9, 9), reason(0, 0, 101, 9), reason(0, 0, 3, 30), reason(0, 0, 30, 3), reason(0, 0, 24, 24), reason(0, 0, 99, 99)]
    assert got == [
        None, "missing_bbox", "bbox_non_finite", "bbox_non_positive", "bbox_outside_canvas", "bbox_outside_canvas", "bbox_width_below_minimum", "bbox_height_below_minimum", "bbox_area_below_minimum", "bbox_area_ratio_above_maximum",
    ]


def test_pearson_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(agg.pearson(c("x"), c("y")).alias("r")).first().r is None
    assert df.limit(1).agg(agg.pearson(c("x"), c("y")).alias("r")).first().r is None


def test_median_then_corr_fixture(spark):
    rows = [("a", 0.5, 1.0), ("a", 0.5, 3.0), ("a", 0.5, 2.0), ("b", 2.0, 0.5), ("c", 4.0, 0.25)]
    df = spark.createDataFrame(rows, "pair string, gain double, alpha double")
    r = agg.median_then_corr(df, "pair", "alpha", "gain").first()
    assert (r.episodes, r.with_inverse) == (3, 1.0)


def test_advantages(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 0.0), ("g", 0.0), ("g", 1.0), ("s", 7.0)], "g string, r double")
    got = sorted(r.v for r in df.select(agg.advantages(df, "g", "r").alias("v")).collect())
    assert got[-1] == 7.0 and abs(got[-2] - 0.5 / (0.5 + 1e-6)) < 1e-12 and abs(got[0] + 0.5 / (0.5 + 1e-6)) < 1e-12


def test_largest_remainder_with_caps(spark):
    df = spark.createDataFrame([("A", 5), ("B", 3), ("C", 2)], "k string, n int")
    got = {r.k: r.quota for r in W.largest_remainder(df, "n", 4, "k", "n").collect()}
    assert got == {"A": 2, "B": 1, "C": 1}


def test_sliding_windows(spark):
    df = spark.createDataFrame([(1, 0), (2, 2), (3, 5)], "id int, n long")
    got = sorted((r.id, r.stop, r.targets_from) for r in W.sliding(df, "id", "n").collect())
    assert got == [(2, 2, 0), (3, 3, 0), (3, 4, 3), (3, 5, 4)]


def test_evenly_spread_positions(spark):
    df = spark.range(8).withColumn("g", F.lit(1))
    assert sorted(r.i for r in W.evenly_spread(df, "g", "id", 2).collect()) == [2, 6]


def test_components_by_shared_keys(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "x", "p"), (3, None, "p"), (4, None, None)], "id long, a string, b string")
    got = {r.node: r.label for r in D.key_components(df, "id", ["a", "b"]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.label for r in D.components(edges).collect()} == {0}


def test_asof_and_bands(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, ts int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b")], "k int, ts int, v string")
    got = {(r.k, r.ts): r.v for r in R.asof(left, right, ["k"], "ts", "v").collect()}
    assert got == {(1, 5): "b", (1, 1): None, (2, 9): None}
    bands = spark.createDataFrame([(0.0, 7.0, "low"), (7.0, 90.0, "high")], "low double, high double, band string")
    df = spark.createDataFrame([(6.9,), (7.0,), (90.0,)], "x double")
    assert sorted((r.x, r.band) for r in R.band_join(df, bands, "x", 10.0).collect()) == [(6.9, "low"), (7.0, "high")]


def test_coverage(spark):
    e = spark.createDataFrame([(1,), (2,)], "id int")
    o = spark.createDataFrame([(2,), (2,), (3,)], "id int")
    assert {r.id: r.status for r in R.coverage(e, o, "id").collect()} == {1: "missing", 2: "duplicate", 3: "unexpected"}


def test_greedy_fold_fills_the_shares():
    out = W.fold_greedy([(i, {("total", "*"): 10, ("category", "ab"[i % 2]): 10}) for i in range(24)])
    assert len(out) == 24 and [s for _, s in out].count("train") == 20
    assert W.fold_greedy([]) == []


def resized(w, h, factor, least, most):
    near = lambda v, f: max(factor, f(v / factor) * factor)
    a, b = near(w, round), near(h, round)
    if least <= a * b <= most:
        return a, b
    if a * b > most:
        r = (w * h / most) ** 0.5
        a, b = near(w / r, math.floor), near(h / r, math.floor)
    else:
        r = (least / (w * h)) ** 0.5
        a, b = near(w * r, math.ceil), near(h * r, math.ceil)
    while a * b > most and max(a, b) > factor:
        a, b = (a - factor, b) if a >= b and a > factor else (a, b - factor)
    while a * b < least:
        a, b = (a + factor, b) if a / w <= b / h else (a, b + factor)
    return a, b


def test_smart_resize(spark):
    sizes = [(w, h) for w in (1, 30, 56, 100, 640, 1999, 4000) for h in (3, 28, 99, 720, 1500) if max(w, h) / min(w, h) <= 200]
    df = spark.createDataFrame([(float(w), float(h)) for w, h in sizes], "w double, h double")
    a, b = G.smart_resize(c("w"), c("h"), 28, 4 * 784, 200 * 784)
    got = {(r.w, r.h): (r.a, r.b) for r in df.select("w", "h", a.alias("a"), b.alias("b")).collect()}
    assert got == {(w, h): resized(w, h, 28, 4 * 784, 200 * 784) for w, h in sizes}


def test_greedy_clusters(spark):
    df = spark.createDataFrame([("h", 1, [0.0, 0.0]), ("h", 2, [0.5, 0.0]), ("h", 3, [1.4, 0.0]), ("h", 4, [0.0, 0.0])], "b string, id long, v array<double>")
    got = {r.id: r.cluster for r in D.greedy_clusters(df, "b", "id", "v", 1.0).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}
