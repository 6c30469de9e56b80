"""Joins and set relations with their contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .window import id_range, ranked


def coverage(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Each id that isn't seen exactly once as expected: missing, unexpected or duplicate."""
    e = expected.select(key).distinct().withColumn("e", F.lit(True))
    o = observed.groupBy(key).agg(F.count("*").alias("n"))
    why = F.when(F.col("n").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("n") > 1, "duplicate")
    return e.join(o, key, "full").select(key, why.alias("status"), F.coalesce("n", F.lit(0).cast("long")).alias("n")).where("status IS NOT NULL")


def zipped(a: DataFrame, b: DataFrame, order_a: Sequence[str], order_b: Sequence[str], shard: str) -> DataFrame:
    """Rows of equal place in order within a shard, side by side; a missing partner is null.

    Position is an explicit order in each shard, never file order.
    """
    left = a.withColumn("place", F.row_number().over(Window.partitionBy(shard).orderBy(*order_a)))
    right = b.withColumn("place", F.row_number().over(Window.partitionBy(shard).orderBy(*order_b)))
    return left.join(right, [shard, "place"], "full")


def pair_differences(df: DataFrame, key: str, side: str, first: str, second: str, fields: Sequence[str]) -> DataFrame:
    """Pairs of the two sides with the names of the fields that differ."""
    a = df.where(F.col(side) == first).select(key, *[F.col(f).alias(f"a_{f}") for f in fields])
    b = df.where(F.col(side) == second).select(key, *[F.col(f).alias(f"b_{f}") for f in fields])
    differ = F.array_compact(F.array(*[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), f) for f in fields]))
    return a.join(b, key).withColumn("differs", differ)


def in_all_arms(df: DataFrame, key: str, arm: str, arms: int, valid: Column) -> DataFrame:
    """Each id: kept (valid in all arms), intrinsic (valid in none) or paired (lost through another arm)."""
    g = df.groupBy(key).agg(F.count_if(valid).alias("good"), F.countDistinct(arm).alias("arms"))
    return g.withColumn("status", F.when((F.col("good") == F.col("arms")) & (F.col("arms") == arms), "kept").when(F.col("good") == 0, "intrinsic").otherwise("paired"))


def reuse(new: DataFrame, old: DataFrame, keys: Sequence[str], same: Sequence[str], value: str) -> DataFrame:
    """New rows with the old value where a row of the key agrees in ``same``; ``reused`` says so."""
    prior = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in same], F.col(value).alias("old_value"))
    agree = F.lit(True)
    for c in same:
        agree = agree & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    out = new.join(prior, list(keys), "left")
    hit = F.coalesce(agree & F.col("old_value").isNotNull(), F.lit(False))
    return out.withColumn(value, F.when(hit, F.col("old_value")).otherwise(F.col(value))).withColumn("reused", hit).drop("old_value", *[f"old_{c}" for c in same])


def compare_runs(a: DataFrame, b: DataFrame, key: str, success: str) -> DataFrame:
    """Baseline against candidate, one row: agreement, only-a, only-b, both, neither, unmatched."""
    x, y = a.select(key, F.col(success).alias("sa")), b.select(key, F.col(success).alias("sb"))
    j = x.join(y, key, "full")
    sa, sb = F.col("sa"), F.col("sb")
    return j.agg(
        F.count_if(sa == sb).alias("agree"), F.count_if(sa & ~sb).alias("only_a"), F.count_if(~sa & sb).alias("only_b"), F.count_if(sa & sb).alias("both"), F.count_if(~sa & ~sb).alias("neither"), F.count_if(sa.isNull() | sb.isNull()).alias("unmatched")
    )


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """Left rows with the latest right value at or before their time, without a range join.

    Both sides are one stream in time order by key; the last non-null right
    value before a row is its match. A right row at the same time counts.
    """
    a = left.withColumn("__side", F.lit(1)).withColumn(value, F.lit(None).cast(right.schema[value].dataType))
    b = right.select(*keys, ts, F.col(value)).withColumn("__side", F.lit(0))
    w = Window.partitionBy(*keys).orderBy(ts, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(value, F.last(value, True).over(w)).where("__side = 1").drop("__side")


def band_join(df: DataFrame, bands: DataFrame, value: str, width: float) -> DataFrame:
    """Rows with each band [low, high) that holds their value, as an equi-join on grid cells.

    A band is listed under the cells of ``width`` that it touches, so no side is
    broadcast and no pair outside a cell is compared.
    """
    cells = bands.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    own = df.withColumn("cell", F.floor(F.col(value) / width))
    return own.join(cells, "cell").where((F.col(value) >= F.col("low")) & (F.col(value) < F.col("high"))).drop("cell")


def overlaps(df: DataFrame, key: str, split: str) -> DataFrame:
    """For each pair of splits, how many keys both hold, from one aggregation by key."""
    sets = df.select(key, split).distinct().groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    pairs = F.explode(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
    return sets.select(pairs.alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def cyclic(a: DataFrame, b: DataFrame, order_a: Sequence[str], order_b: Sequence[str], shard: str) -> DataFrame:
    """The i-th row of a with row i mod |b| of b, within a shard; each order begins with an integer column."""
    left = ranked(a, [shard], order_a, id_range(F.col(order_a[0])), "__i")
    right = ranked(b, [shard], order_b, id_range(F.col(order_b[0])), "__j")
    n = right.groupBy(shard).agg(F.count("*").alias("__n"))
    return left.join(n, shard).withColumn("__j", F.col("__i") % F.col("__n")).join(right, [shard, "__j"]).drop("__i", "__j", "__n")
