"""Rules with typed reasons, and gates that say how many rows break a contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Rule = tuple[str, Column]


def first_reason(rules: Sequence[Rule]) -> Column:
    """The code of the first rule that holds (a rule says what is wrong), else null."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), code) for code, bad in rules])


def split_rejects(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(rows without a reason, rows with ``reason``)."""
    judged = df.withColumn("reason", first_reason(rules))
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def gate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule, n_bad) for each rule, in one pass over ``df``."""
    counts = df.agg(*[F.count_if(F.coalesce(bad, F.lit(True))).alias(code) for code, bad in rules])
    return counts.unpivot([], [code for code, _ in rules], "rule", "n_bad")


def unique_gate(df: DataFrame, keys: Sequence[str], rule: str = "duplicate") -> DataFrame:
    """(rule, n_bad): how many keys occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.lit(rule).alias("rule"), F.count_if(F.col("n") > 1).alias("n_bad"))


def count_gate(df: DataFrame, key: str, expected: int, rule: str = "count") -> DataFrame:
    """(rule, n_bad): how many groups don't have the expected number of rows."""
    return df.groupBy(key).agg(F.count("*").alias("n")).agg(F.lit(rule).alias("rule"), F.count_if(F.col("n") != expected).alias("n_bad"))


def require(gates: DataFrame) -> None:
    """Raise ValueError with the rules that have bad rows."""
    bad = gates.where("n_bad > 0").orderBy("rule").limit(100).collect()
    if bad:
        raise ValueError("; ".join(f"{r.rule}: {r.n_bad}" for r in bad))


def finite_bbox(b: Column) -> Column:
    """A box of four finite numbers with x1 < x2, y1 < y2, none negative; else null."""
    good = (F.size(b) == 4) & F.forall(b, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & (v >= 0)) & (b[0] < b[2]) & (b[1] < b[3])
    return F.when(good, b)


# Limits of an annotated box, and what may not be published.
LEAST_WIDTH, LEAST_HEIGHT, LEAST_AREA, MOST_SHARE = 24.0, 18.0, 600.0, 0.20
ORACLE_KEYS = ("bbox", "bounding_box", "bbox_pixels", "target_point", "target_pixel_xy", "target_model_xy", "waypoint", "waypoints", "waypoints_pixel_xy", "waypoints_model_xy", "source_target_index", "ground_truth", "element_id", "dom", "oracle")
PRIVATE_WORDS = ("bbox", "ground_truth", "source_identity", "target_model_xy")
EVALUATOR_PARTS = ("variant", "sensitivity", "target_idx", "target_index", "target_xy", "target_coord", "target_angle", "rotation_direction", "oracle", "success_geometry")
HASH_KEY = r"(^|[_-])(sha(\d+)?|hash|digest)($|[_-])"


def bbox_reason(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column, least_width: float = LEAST_WIDTH, least_height: float = LEAST_HEIGHT, least_area: float = LEAST_AREA, most_share: float = MOST_SHARE) -> Column:
    """Why a box is rejected: the first of eight reasons, or null."""
    vals = (x1, y1, x2, y2)
    missing, odd = F.lit(False), F.lit(False)
    for v in vals:
        missing = missing | v.isNull()
        odd = odd | F.isnan(v) | (F.abs(v) == float("inf"))
    bw, bh = x2 - x1, y2 - y1
    return first_reason([
        ("missing_bbox", missing), ("bbox_non_finite", odd), ("bbox_non_positive", (bw <= 0) | (bh <= 0)), ("bbox_outside_canvas", (x1 < 0) | (y1 < 0) | (x2 > w) | (y2 > h)),
        ("bbox_width_below_minimum", bw < least_width), ("bbox_height_below_minimum", bh < least_height), ("bbox_area_below_minimum", bw * bh < least_area), ("bbox_area_ratio_above_maximum", bw * bh / (w * h) > most_share),
    ])


def has_word(c: Column, words: Sequence[str] = PRIVATE_WORDS) -> Column:
    """A text has one of the words, in any case."""
    out = F.lit(False)
    for w in words:
        out = out | F.lower(c).contains(w)
    return out


def leaking_keys(keys: Column, parts: Sequence[str] = EVALUATOR_PARTS) -> Column:
    """The keys, in lower case and sorted, that hold one of the parts."""
    low = F.transform(keys, F.lower)
    return F.array_sort(F.filter(low, lambda k: has_word(k, parts)))


def publishable(c: Column) -> Column:
    """A JSON text without hash-like keys and think tags, at any depth."""
    keys = F.regexp_extract_all(F.lower(c), F.lit(r'"([^"\\]*)"\s*:'), F.lit(1))
    return ~F.exists(keys, lambda k: k.rlike(HASH_KEY)) & ~F.lower(c).rlike("</?think>")


def aligned(arrays: Sequence[Column], n: Column) -> Column:
    """All arrays have n elements."""
    out = F.lit(True)
    for a in arrays:
        out = out & (F.size(a) == n)
    return out


def forbidden_fields(schema: T.StructType, names: Sequence[str], path: str = "row") -> list[str]:
    """Paths of fields with a forbidden name anywhere in a schema."""
    found, banned = [], {n.lower() for n in names}

    def walk(kind: T.DataType, at: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                here = f"{at}.{f.name}"
                if f.name.lower() in banned:
                    found.append(here)
                walk(f.dataType, here)
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, f"{at}[]")
        elif isinstance(kind, T.MapType):
            walk(kind.valueType, f"{at}{{}}")

    walk(schema, path)
    return found


def json_has_key(c: Column, names: Sequence[str]) -> Column:
    """A JSON text has one of the keys at any depth."""
    return F.lower(c).rlike('"(' + "|".join(n.lower() for n in names) + r')"\s*:')


def source_contract(steps: Column) -> Column:
    """First broken rule of a trajectory of (type, kind, x, y) steps, or null.

    Observations and actions alternate and an observation comes first; the last
    action is a click; one to three moves come before it; coordinates lie in 0..1000.
    """
    n = F.size(steps)
    kinds = F.filter(steps, lambda s: s.type == "action")
    moves = F.size(F.filter(kinds, lambda s: s.kind == "move"))
    turns = F.transform(steps, lambda s, i: s.type == F.when(i % 2 == 0, "observation").otherwise("action"))
    return first_reason([
        ("empty", n == 0), ("not_alternating", ~F.forall(turns, lambda ok: ok)), ("odd_end", n % 2 == 1), ("no_click", F.element_at(kinds, -1).kind != "click"),
        ("moves", ~moves.between(1, 3)), ("early_click", F.size(F.filter(kinds, lambda s: s.kind == "click")) != 1), ("coordinate", ~F.forall(kinds, lambda s: s.x.between(0, 1000) & s.y.between(0, 1000))),
    ])


def scan_sequence(kinds: Column) -> Column:
    """Moves only, then one down and one up at the end."""
    return F.array_join(kinds, " ").rlike(r"^(move )+down up$")


def meaningful(m: Column, least: float = 1e-9) -> Column:
    """Some value of a map of numbers differs from zero."""
    return F.exists(F.map_values(m), lambda v: F.abs(v) > least)
