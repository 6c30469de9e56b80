"""Connected components of an edge table, and unions of documents by id."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, ship

#: Edge tables up to this size (16 MB) are finished by one task; larger ones never meet in one.
LOCAL_EDGES = 1_000_000
PAIR = "a long, b long"


class Unions:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars around its smallest nodes; flushed at a bounded size."""
    u, held = Unions(), 0

    def flush() -> pa.RecordBatch:
        rows = [(x, u.find(x)) for x in list(u.up)]
        rows = [r for r in rows if r[0] != r[1]]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            u.join(a, b)
        held += batch.num_rows
        if held > 4 * LOCAL_EDGES:
            yield flush()
            u, held = Unions(), 0
    yield flush()


def components(edges: DataFrame, space: Workspace, name: str, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, label) of every node with an edge; label is the component's smallest node.

    ``edges(a, b)`` may repeat, run either way and hold loops. Small tables are
    done in one task; others by alternating large-star and small-star rounds,
    each written to the workspace, whose sums are pre-aggregated by node.
    """
    ship(edges.sparkSession)
    step = space.put(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(_contract, PAIR), f"{name}-0")
    if step.count() <= local_edges:
        done = space.put(step.coalesce(1).mapInArrow(_contract, PAIR), f"{name}-all")
    else:
        done, last, i = step, None, 0
        while True:
            both = done.select("a", "b").unionByName(done.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
            i += 1
            done = space.put(small, f"{name}-{i}")
            state = done.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if i > 1:
                space.drop(f"{name}-{i - 1}")
            if tuple(state) == last:
                break
            last = tuple(state)
    nodes = done.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.unionByName(done.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
