"""JSON: canonical forms, tool calls, action texts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let

TOOL_CALL = r"(?s)^\s*<tool_call>\s*(\{.*\})\s*</tool_call>\s*$"
CALL = "name string, arguments struct<action:string, coordinate:array<int>, status:string>"
ACTION = T.StructType([T.StructField("kind", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("reason", T.StringType())])


def canonical(c: Column) -> Column:
    """A JSON text with sorted keys and normal numbers; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(c))


def canonical_row(c: Column) -> Column:
    """A struct as canonical JSON, nulls kept."""
    return F.to_json(F.parse_json(F.to_json(c, {"ignoreNullFields": "false"})))


def format_tool_call(action: Column, coordinate: Column | None = None, status: Column | None = None, name: str = "computer_use") -> Column:
    parts = [action.alias("action")]
    if coordinate is not None:
        parts.append(coordinate.alias("coordinate"))
    if status is not None:
        parts.append(status.alias("status"))
    body = F.to_json(F.struct(F.lit(name).alias("name"), F.struct(*parts).alias("arguments")))
    return F.concat(F.lit("<tool_call>\n"), body, F.lit("\n</tool_call>"))


def parse_tool_call(c: Column, name: str = "computer_use") -> Column:
    """Strict: one call, exact keys, the expected name, a left_click with a coordinate in 0..1000 or a terminate with its status; struct or null."""
    alone = ~F.lower(c).rlike("</?think>") & (F.size(F.regexp_extract_all(c, F.lit("<tool_call>"), F.lit(0))) == 1)
    body = F.when(alone, F.nullif(F.regexp_extract(c, TOOL_CALL, 1), F.lit("")))

    def fits(call: Column, body: Column) -> Column:
        args = call.arguments
        outer = F.array_join(F.array_sort(F.json_object_keys(body)), ",") == "arguments,name"
        inner = F.array_join(F.array_sort(F.json_object_keys(F.get_json_object(body, "$.arguments"))), ",")
        click = (args.action == "left_click") & (inner == "action,coordinate") & (F.size(args.coordinate) == 2) & F.forall(args.coordinate, lambda v: v.between(0, 1000))
        end = (args.action == "terminate") & (inner == "action,status") & args.status.isin("success", "failure")
        return F.when((call.getField("name") == name) & outer & (click | end), args)

    def judge(body: Column) -> Column:
        return F.when(F.try_parse_json(body).isNotNull(), let(F.from_json(body, CALL), lambda call: fits(call, body)))

    return let(body, judge)


def parse_final_click(c: Column, name: str = "computer_use") -> Column:
    """The coordinate if the text is one left_click call, else null."""
    return let(parse_tool_call(c, name), lambda args: F.when(args.action == "left_click", args.coordinate))


def repair_object(c: Column) -> Column:
    """The outermost {...} of a noisy text if that is JSON (code fences and chatter go)."""
    body = F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.when(F.try_parse_json(body).isNotNull(), body)


def _strict(text: str | None) -> tuple | None:
    def pairs(items: list) -> dict:
        if len({k for k, _ in items}) != len(items):
            raise ValueError("a key is there twice")
        return dict(items)

    def no_constant(value: str) -> None:
        raise ValueError(value)

    if text is None:
        return None
    try:
        data = json.loads(text, object_pairs_hook=pairs, parse_constant=no_constant)
    except ValueError as e:
        return (None, None, None, str(e).split(":")[0])
    if not isinstance(data, dict) or set(data) != {"kind", "x", "y"}:
        return (None, None, None, "wrong keys")
    if any(type(data[k]) is not int for k in "xy"):
        return (None, None, None, "not an integer")
    return (str(data["kind"]), float(data["x"]), float(data["y"]), None)


@F.pandas_udf(ACTION)
def parse_strict_action(texts: pd.Series) -> pd.DataFrame:
    """An action from its raw text, a batch at a time: duplicate keys, NaN and non-integers are rejected, which VARIANT would not see."""
    seen: dict = {}
    rows = [seen[t] if t in seen else seen.setdefault(t, _strict(t)) for t in texts]
    return pd.DataFrame([r or (None,) * len(ACTION.names) for r in rows], columns=ACTION.names)


def parse_actions(c: Column) -> Column:
    """Actions of several dialects in one text, in order: JSON objects, ``click(x, y)``, ``CLICK <x> <y>``.

    An array of ``kind x y`` texts; what isn't an action is passed over.
    """
    pattern = r'(?i)(?:\{\s*"kind"\s*:\s*"(\w+)"\s*,\s*"x"\s*:\s*(\d+)\s*,\s*"y"\s*:\s*(\d+)\s*\}|(\w+)\(\s*(\d+)\s*,\s*(\d+)\s*\)|\b(CLICK|MOVE)\s+<?(\d+)>?\s+<?(\d+)>?)'
    each = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return F.transform(each, lambda a: F.concat_ws(" ", F.lower(F.regexp_extract(a, r"([A-Za-z_]+)(?=[\"\(\s])(?!\"\s*:)", 1)), F.regexp_extract(a, r"(\d+)\D+(\d+)\D*$", 1), F.regexp_extract(a, r"(\d+)\D+(\d+)\D*$", 2)))


def _equal(a: str | None, b: str | None) -> bool | None:
    if a is None or b is None:
        return None

    def same(x, y) -> bool:
        if type(x) is not type(y):
            return False
        if isinstance(x, dict):
            return x.keys() == y.keys() and all(same(x[k], y[k]) for k in x)
        if isinstance(x, list):
            return len(x) == len(y) and all(map(same, x, y))
        return x == y

    try:
        return same(json.loads(a), json.loads(b))
    except ValueError:
        return False


@F.pandas_udf(T.BooleanType())
def equal_exact(a: pd.Series, b: pd.Series) -> pd.Series:
    """Equal JSON, a batch at a time: 1 and 1.0 and true differ, which VARIANT would not see."""
    return pd.Series([_equal(x, y) for x, y in zip(a, b)], dtype=object)
