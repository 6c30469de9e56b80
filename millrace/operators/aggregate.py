"""Aggregates of evaluation records, trajectories and groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_by(df: DataFrame, keys: Sequence[str], classes: DataFrame | None = None) -> DataFrame:
    """Rows by key; with a table of classes, a zero for those without rows."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return n if classes is None else classes.join(n, list(keys), "left").fillna(0, ["n"])


def merge_maps(df: DataFrame, column: str) -> DataFrame:
    """(key, n) summed over a column of count maps."""
    return df.select(F.explode(column).alias("key", "v")).groupBy("key").agg(F.sum("v").alias("n"))


def pearson(x: Column, y: Column) -> Column:
    """Correlation; null for fewer than two points or a constant side."""
    return F.try_divide(F.covar_samp(x, y), F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0)))


def success_table(df: DataFrame, variant: str, success: str, infra: Column) -> DataFrame:
    """By variant, and over all (variant null): episodes, successes, rate, infra errors."""
    return df.rollup(variant).agg(F.count("*").alias("n"), F.count_if(F.col(success)).alias("successes"), F.round(F.avg(F.col(success).cast("int")), 6).alias("rate"), F.count_if(infra).alias("infra"))


def top_k(df: DataFrame, key: str, first: str, k: int) -> DataFrame:
    """The k most common values; ties by first appearance, then by name."""
    g = df.groupBy(key).agg(F.count("*").alias("n"), F.min(first).alias("first"))
    return g.orderBy(F.desc("n"), "first", key).limit(k).select(key, "n")


def concentration(df: DataFrame, key: str) -> DataFrame:
    """One row: Herfindahl index, largest share, number of values."""
    n = df.groupBy(key).agg(F.count("*").cast("double").alias("n"))
    s = n.agg(F.sum(F.col("n") * F.col("n")).alias("sq"), F.sum("n").alias("all"), F.max("n").alias("top"), F.count("*").alias("values"))
    return s.select(F.round(F.try_divide("sq", F.col("all") * F.col("all")), 9).alias("hhi"), F.round(F.try_divide("top", F.col("all")), 9).alias("largest"), "values")


def advantages(df: DataFrame, group: str, reward: str, epsilon: float = 1e-6) -> Column:
    """(r - mean) / (population deviation + epsilon) in a group; the raw reward alone in one."""
    w = Window.partitionBy(group)
    r = F.col(reward)
    return F.when(F.count("*").over(w) == 1, r).otherwise((r - F.avg(r).over(w)) / (F.stddev_pop(r).over(w) + epsilon))


def step_weights(key: str) -> Column:
    return F.lit(1.0) / F.count("*").over(Window.partitionBy(key))


def step_gate(df: DataFrame, key: str, index: str, reward: str) -> DataFrame:
    """Each trajectory with whether its indices run from 0 without gaps and only the last step is rewarded."""
    g = df.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(index).alias("d"), F.min(index).alias("low"), F.max(index).alias("high"), F.max(F.when(F.col(reward).isNotNull(), F.col(index))).alias("paid"), F.count(reward).alias("pays"))
    good = (F.col("n") == F.col("d")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("pays") == 1) & (F.col("paid") == F.col("high"))
    return g.select(key, F.coalesce(good, F.lit(False)).alias("ok"))


def max_runs(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Longest run of equal neighbours by key (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(order)
    new = df.withColumn("__new", (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    isl = new.withColumn("__isle", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return isl.groupBy(key, "__isle").agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("longest"))


def transitions(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """How often neighbours differ, by key."""
    w = Window.partitionBy(key).orderBy(order)
    prev = df.select(key, F.col(value).alias("v"), F.lag(value).over(w).alias("p"), F.row_number().over(w).alias("i"))
    return prev.groupBy(key).agg(F.count_if((F.col("i") > 1) & ~F.col("v").eqNullSafe(F.col("p"))).alias("changes"))


def ordered_hash(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """sha256 of a group's values in order, a line each. A group's values are one row's worth."""
    seq = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x.v.cast("string"))
    return df.groupBy(key).agg(F.sha2(F.concat(F.array_join(seq, "\n"), F.lit("\n")), 256).alias("digest"))


def conflict_ceiling(df: DataFrame, key: Sequence[str], target: str) -> DataFrame:
    """One row: inputs, those with several targets, and the accuracy that majority answers reach."""
    n = df.groupBy(*key, target).agg(F.count("*").alias("n"))
    by = n.groupBy(*key).agg(F.count("*").alias("targets"), F.max("n").alias("major"), F.sum("n").alias("rows"))
    return by.agg(F.count("*").alias("inputs"), F.count_if(F.col("targets") > 1).alias("conflicts"), F.round(F.try_divide(F.sum("major"), F.sum("rows")), 9).alias("ceiling"))


def median_then_corr(df: DataFrame, episode: str, value: str, gain: str) -> DataFrame:
    """Median by episode, then correlation with the gain and its inverse, weighting episodes alike."""
    per = df.groupBy(episode).agg(F.median(value).alias("m"), F.min(gain).alias("g"))
    return per.agg(F.count("*").alias("episodes"), F.round(pearson(F.col("m"), F.col("g")), 6).alias("with_gain"), F.round(pearson(F.col("m"), 1 / F.col("g")), 6).alias("with_inverse"))
