"""Mixing sources to target weights, on DataFrame operations alone.

Every document gets a hash-random key. Within its source, documents are sorted
by that key, and a prefix sum of their word counts is cut at the source's exact
budget. The prefix sum is distributed: the key space of each source is cut into
equal ranges, as many as ``SPAN_ROWS`` and the number of rows ask for (the keys
are uniform, so ranges of keys hold nearly equal shares, and a source with a
third of all rows is dealt to as many tasks as any other rows). A range's total
is a pre-aggregated sum, and the offset of a range is a running sum over the few
totals. The targets come from one row for each source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Workspace, as_text, table

#: Weights in code-point order of the sources, repeating.
WEIGHTS = (1, 2, 3)
#: Rows of all sources together that a range of keys may hold, about.
SPAN_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.regexp_count(as_text(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """Targets of ``sizes(source, source_size)``: weighted shares of all sizes.

    A target stops at ``max_epochs`` times its source's size; the excess goes to
    the others by weight until none is above. That fixed point is reached at
    once: taken in ascending order of cap over weight, the capped sources are
    the leading ones whose cap is below their share of what is left.
    Sources sort by code point, null last. Rows: one for each source.
    """
    k = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.col("place") % k + 1).cast("int"))
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    on = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    filled = (
        sizes.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(all_rows))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(on))
        .withColumn("capped", F.col("cap") * F.col("weight_left") <= F.col("left") * F.col("weight"))
        .withColumn("free_left", F.max(F.when(~F.col("capped"), F.col("left"))).over(all_rows))
        .withColumn("free_weight", F.max(F.when(~F.col("capped"), F.col("weight_left"))).over(all_rows))
    )
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("free_left") * F.col("weight") / F.col("free_weight"))
    return filled.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = 3, seed: str = "mix", digits: int | None = None, carry: bool = False) -> DataFrame:
    """What the mix takes of every document; with ``carry``, its whole row too, as ``row``.

    Returns doc_id, size (words), source_size, target, taken and copies. ``taken``
    counts words with repeats: every document of a source goes in once for each
    whole epoch of the budget, and the last epoch runs in key order up to the
    budget, so one document of a source may give only its first words. ``copies``
    is the same in whole documents: the cut document counts if at least half of
    it is within the budget. ``taken`` never exceeds ``max_epochs`` sizes.

    Null texts count no words, a null source is a source of its own (the last),
    a null doc_id is keyed like the text ``null`` and sorts first. ``digits``, hex
    digits of a range's name, follows from the rows if not given. Repeated rows
    are rows of their own; equal rows may swap their cuts. Columns other than
    doc_id, text and source are ignored. An empty table gives an empty result.
    """
    more = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(*more, "doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("key"))
    carried = ["row"] if carry else []
    if not carry:  # read twice below: the texts are counted once, and a few bytes a row are written
        rows = Workspace(docs.sparkSession, "mix").put(rows, "rows")
    if digits is None:
        digits, total = 3, rows.count()
        while 16**digits * SPAN_ROWS < total:
            digits += 1
    rows = rows.withColumn("span", F.substring("key", 1, digits))
    spans = rows.groupBy("source", "span").agg(F.sum("size").alias("span_size"))
    sizes = spans.groupBy("source").agg(F.sum("span_size").alias("source_size"))
    offset = F.sum("span_size").over(Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("span_size")
    targets = source_targets(sizes, weights, max_epochs)
    starts = spans.withColumn("offset", offset).alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "s.span", "offset", "source_size", "target")
    inside = Window.partitionBy("source", "span").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("size").over(inside)).alias("r").join(starts.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.span") == F.col("o.span")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return (
        placed.select(*carried, "doc_id", "size", "source_size", "target", (F.col("offset") + F.col("upto") - F.col("size")).alias("start"))
        .withColumn("epochs", epochs)
        .withColumn("rest", F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), budget - F.col("epochs") * F.col("source_size") - F.col("start"))))
        .select(
            *carried, "doc_id", "size", "source_size", "target",
            (F.col("epochs") * F.col("size") + F.col("rest")).alias("taken"),
            (F.col("epochs") + F.when((F.col("rest") > 0) & (2 * F.col("rest") >= F.col("size")), 1).otherwise(0)).alias("copies"),
        )
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``mix`` has copies of it."""
    taken = mix(docs, carry=True, **options).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op10_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, place % 3 + 1 AS weight, source_size * 3 AS cap FROM s),
f AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
             coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped_before,
             (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weight_left FROM w),
g AS (SELECT *, total - capped_before AS rest, cap * weight_left <= (total - capped_before) * weight AS capped FROM f),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE (max(CASE WHEN NOT capped THEN rest END) OVER () * weight)::DOUBLE / max(CASE WHEN NOT capped THEN weight_left END) OVER () END AS target FROM g),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - d.size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
        + least(size, greatest(0, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - start)))::BIGINT AS taken
FROM p
"""
