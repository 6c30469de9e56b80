"""The registry of queries, and the roles that the tables play in them."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: SQL of the roles; a query's SQL may name them like tables.
ROLES = {
    "records": """SELECT event_id AS id, user_id AS episode, event_type AS variant, value >= 50 AS success, value, ts,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 20 + 1 AS turns,
  CASE user_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM events""",
    "boxes": """SELECT id, k, variant, episode, 1280.0::DOUBLE AS w, 720.0::DOUBLE AS h, (k * 12)::DOUBLE AS x1, ((id * 37) % 700)::DOUBLE AS y1,
  k * 12 + value AS x2, ((id * 37) % 700 + id % 97)::DOUBLE AS y2, ((id * 13) % 1280)::DOUBLE AS px, ((id * 29) % 720)::DOUBLE AS py FROM records""",
    "steps": """SELECT conv_id AS id, turn AS pos, role, text, length(text) AS n, (length(text) * 7 + turn * 13) % 1001 AS x, (conv_id * 31 + turn * 17) % 1001 AS y,
  CASE role WHEN 'assistant' THEN 'action' WHEN 'user' THEN 'observation' ELSE 'system' END AS kind FROM conversations""",
    "cands": "SELECT doc_id AS id, source AS platform, lang AS category, text, length(text) AS n FROM documents",
}
_USES = {"boxes": ("records",)}


def _with_roles(sql: str) -> str:
    used = [r for r in ROLES if re.search(rf"\b{r}\b", sql)]
    need = [r for r in ROLES if r in used or any(r in _USES.get(u, ()) for u in used)]
    if not need:
        return sql
    head = ",\n".join(f"{r} AS ({ROLES[r]})" for r in need)
    body = re.sub(r"^\s*WITH( RECURSIVE)?\b", "", sql, flags=re.I)
    return ("WITH RECURSIVE " if "RECURSIVE" in sql else "WITH ") + head + (",\n" + body if body != sql else "\n" + sql)


class Tables:
    """The tables of a folder, and the roles as DataFrames."""

    def __init__(self, spark: SparkSession, where: str) -> None:
        self.spark, self.where = spark, where

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.where}/{name}.parquet")

    @cached_property
    def records(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("long")
        split = F.when(F.col("user_id") % 10 == 0, "test").when(F.col("user_id") % 10 == 1, "val").otherwise("train")
        return self.events.select(
            F.col("event_id").alias("id"), F.col("user_id").alias("episode"), F.col("event_type").alias("variant"), (F.col("value") >= 50).alias("success"), "value", "ts", k.alias("k"), (F.col("event_id") % 20 + 1).alias("turns"), split.alias("split")
        )

    @cached_property
    def boxes(self) -> DataFrame:
        d = lambda c: c.cast("double")
        k, i = F.col("k"), F.col("id")
        return self.records.select(
            "id", "k", "variant", "episode", F.lit(1280.0).alias("w"), F.lit(720.0).alias("h"), d(k * 12).alias("x1"), d(i * 37 % 700).alias("y1"), (k * 12 + F.col("value")).alias("x2"), d(i * 37 % 700 + i % 97).alias("y2"), d(i * 13 % 1280).alias("px"), d(i * 29 % 720).alias("py")
        )

    @cached_property
    def steps(self) -> DataFrame:
        n = F.length("text")
        kind = F.when(F.col("role") == "assistant", "action").when(F.col("role") == "user", "observation").otherwise("system")
        return self.conversations.select(
            F.col("conv_id").alias("id"), F.col("turn").alias("pos"), "role", "text", n.cast("long").alias("n"), ((n * 7 + F.col("turn") * 13) % 1001).cast("long").alias("x"), ((F.col("conv_id") * 31 + F.col("turn") * 17) % 1001).alias("y"), kind.alias("kind")
        )

    @cached_property
    def cands(self) -> DataFrame:
        return self.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("platform"), F.col("lang").alias("category"), "text", F.length("text").cast("long").alias("n"))


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables``; ``sql`` gives the same rows in DuckDB."""

    def add(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is there already")

        def run(spark: SparkSession, where: str) -> DataFrame:
            ship(spark)
            return f(Tables(spark, where))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = _with_roles(sql.strip())
        return f

    return add
