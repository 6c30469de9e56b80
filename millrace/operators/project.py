"""Projections of trajectories, messages and task rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .window import id_range, ranked


def trajectories(steps: DataFrame, key: str = "id", pos: str = "pos") -> DataFrame:
    """One row a trajectory: ``steps`` as an array of structs in order."""
    others = [c for c in steps.columns if c not in (key, pos)]
    return steps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(pos, *others))).alias("steps"))


def flatten_content(content: Column) -> tuple[Column, Column]:
    """(text with an ``<image>`` mark for each image, images in order) of (type, value) parts."""
    text = F.array_join(F.transform(content, lambda p: F.when(p.type == "image", F.lit("<image>")).otherwise(p.value)), "")
    return text, F.transform(F.filter(content, lambda p: p.type == "image"), lambda p: p.value)


def messages_row(df: DataFrame, content: str, metadata: Sequence[str]) -> DataFrame:
    """messages, images, tools (empty) and metadata of a row."""
    text, images = flatten_content(F.col(content))
    message = F.struct(F.lit("user").alias("role"), text.alias("content"))
    return df.select(F.array(message).alias("messages"), images.alias("images"), F.array().cast("array<string>").alias("tools"), F.struct(*metadata).alias("metadata"))


def task_row(df: DataFrame, source: str, agent: str, seed: int, family: Column, config: Sequence[str], extra: Sequence[str]) -> DataFrame:
    """A reinforcement-learning row: data_source, prompt, ability, reward_model, agent_name, seed, task_config, extra_info."""
    index = F.col("row_index")
    return df.select(
        F.lit(source).alias("data_source"), F.array(F.struct(F.lit("user").alias("role"), F.col("instruction").alias("content"))).alias("prompt"), family.alias("ability"),
        F.struct(F.lit("rule").alias("style")).alias("reward_model"), F.lit(agent).alias("agent_name"), (index + seed).alias("seed"), F.struct(*config).alias("task_config"), F.struct("row_index", *extra).alias("extra_info"),
    )


def per_track(df: DataFrame, tracks: Sequence[str]) -> DataFrame:
    """Each row once for each track; the list of tracks is fixed."""
    return df.withColumn("track", F.explode(F.array(*[F.lit(t) for t in tracks])))


def remap_kinds(steps: Column, kinds: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return F.transform(steps, lambda s: s.withField("kind", F.coalesce(pairs[s.kind], s.kind)))


def final_click(steps: Column) -> tuple[Column, Column]:
    """(first observation, last move) of a trajectory."""
    seen = F.filter(steps, lambda s: s.type == "observation")
    moves = F.filter(steps, lambda s: s.kind == "move")
    return F.try_element_at(seen, F.lit(1)), F.try_element_at(moves, F.lit(-1))


def keep_keys(m: Column, allowed: Sequence[str]) -> Column:
    """A map with only the allowed keys, nulls dropped."""
    return F.map_filter(m, lambda k, v: k.isin(*allowed) & v.isNotNull())


def drop_nulls(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def companion(episodes: DataFrame, overrides: dict[str, Column]) -> DataFrame:
    """The episodes and, of each, a copy with some columns replaced."""
    return episodes.unionByName(episodes.withColumns(overrides))


def explode_actions(steps: DataFrame, variant: str, key: str = "id", pos: str = "pos") -> DataFrame:
    """One row an action with its index in the trajectory and the running index in its variant."""
    own = Window.partitionBy(key).orderBy(pos)
    acts = steps.where("kind = 'action'")
    return ranked(acts, [variant], [key, pos], id_range(F.col(key)), "row_index").withColumn("action_index", F.row_number().over(own) - 1)


def history(steps: DataFrame, key: str = "id", pos: str = "pos", images: int = 3) -> DataFrame:
    """Each action with its last observations (at most ``images``) and all earlier actions."""
    here = Window.partitionBy(key).orderBy(pos)
    acts = F.collect_list(F.when(F.col("kind") == "action", F.col(pos))).over(here.rowsBetween(Window.unboundedPreceding, -1))
    seen = F.count_if(F.col("kind") == "observation").over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # By the count of observations so far, the last ones are a range that ends here.
    last = Window.partitionBy(key).orderBy("__seen").rangeBetween(1 - images, Window.currentRow)
    obs = F.array_sort(F.collect_list(F.when(F.col("kind") == "observation", F.col(pos))).over(last))
    return steps.withColumn("responses", acts).withColumn("__seen", seen).withColumn("images", obs).where("kind = 'action'").drop("__seen")


def with_observation(steps: DataFrame, key: str = "id", pos: str = "pos") -> DataFrame:
    """Each action with the step right before it, if that is an observation."""
    w = Window.partitionBy(key).orderBy(pos)
    prev = steps.withColumn("before", F.lag(F.struct("kind", pos)).over(w))
    return prev.where("kind = 'action'").withColumn("observed", F.when(F.col("before.kind") == "observation", F.col(f"before.{pos}"))).drop("before")


def expand_release(episodes: DataFrame, variant: str, key: str, seeds: dict[str, int]) -> DataFrame:
    """Rows numbered in their variant, with a seed of the variant's base plus the number."""
    base = F.create_map(*[F.lit(x) for kv in seeds.items() for x in kv])
    out = ranked(episodes, [variant], [key], id_range(F.col(key)), "row_index")
    return out.withColumn("seed", base[F.col(variant)] + F.col("row_index"))
