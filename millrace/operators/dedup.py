"""Exact and near duplicates of annotations and fingerprints; leakage-safe groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exact(df: DataFrame, content: Column, order: Sequence[str]) -> DataFrame:
    """Each content once: sha, its smallest row by ``order``, and how many rows have it."""
    g = df.withColumn("sha", F.sha2(content, 256)).groupBy("sha").agg(F.min(F.struct(*order)).alias("keep"), F.count("*").alias("n"))
    return g.select("sha", "keep.*", "n")


def text_pool(df: DataFrame, text: Column, order: str) -> DataFrame:
    """The first row of each different non-empty text."""
    rows = df.withColumn("clean", text).where(F.col("clean").isNotNull())
    return rows.groupBy(F.sha2("clean", 256).alias("sha")).agg(F.min(F.struct(order, "clean")).alias("keep")).select("keep.*")


def sign_hash(vector: Column) -> Column:
    """Bits of which values exceed the median, as text: a perceptual hash of a small vector."""
    s = F.array_sort(vector)
    n = F.size(vector)
    median = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return F.array_join(F.transform(vector, lambda v: F.when(v > median, "1").otherwise("0")), "")


def _dct(n: int = 32, low: int = 8) -> np.ndarray:
    """The first ``low`` rows of the orthonormal cosine transform of n values."""
    rows = np.cos(np.pi / n * (np.arange(n) + 0.5) * np.arange(low)[:, None])
    return rows * np.sqrt(np.where(np.arange(low) == 0, 1.0, 2.0) / n)[:, None]


@F.pandas_udf(T.StringType())
def perceptual_hash(pixels: pd.Series) -> pd.Series:
    """64 bits of 32 x 32 grey pixels (1,024 bytes), as text: which of the 8 x 8 lowest frequencies exceed their median.

    The mean (the lowest frequency) doesn't count for the median. A null, or another number of bytes, gives null.
    """
    good = [i for i, p in enumerate(pixels) if p is not None and len(p) == 1024]
    out: list[str | None] = [None] * len(pixels)
    if good:
        grey = np.frombuffer(b"".join(bytes(pixels.iloc[i]) for i in good), np.uint8).reshape(-1, 32, 32).astype(float)
        c = _dct()
        low = (c @ grey @ c.T).reshape(-1, 64)
        low[np.abs(low) < 1e-9] = 0.0
        bits = low > np.median(low[:, 1:], axis=1)[:, None]
        for i, row in zip(good, bits):
            out[i] = "".join("1" if b else "0" for b in row)
    return pd.Series(out, dtype=object)


def greedy_clusters(df: DataFrame, bucket: str, key: str, vector: str, most: float) -> DataFrame:
    """Within a bucket of equal hashes: a row joins the first cluster all of whose members differ by at most ``most``.

    (key, cluster), cluster being its first member. Equal vectors are one
    member, so a bucket holds only the different vectors of one hash.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(key)
        made: list[tuple[int, list[np.ndarray]]] = []
        out = []
        for k, v in zip(p[key], p[vector]):
            v = np.asarray(v, float)
            home = next((c for c in made if all(np.abs(v - m).max() <= most for m in c[1])), None)
            if home is None:
                home = (k, [])
                made.append(home)
            if not any((v == m).all() for m in home[1]):
                home[1].append(v)
            out.append((k, home[0]))
        return pd.DataFrame(out, columns=[key, "cluster"])

    return df.select(bucket, key, vector).groupBy(bucket).applyInPandas(run, f"{key} {kind}, cluster {kind}")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; gone when the JVM ends.

    Where that is unset it is a temporary one if all of Spark is this process, else ValueError is raised.
    """
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not base and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = base or tempfile.gettempdir()
    where = f"{base.rstrip('/')}/rounds-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return where


def components(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, label): smallest reachable node, by rounds of neighbour minima and pointer jumps.

    Each round is a written table, so no lineage builds up and a lost executor
    repeats one round at most; the tables of the round before are deleted.
    """
    spark, folder = edges.sparkSession, shared_folder(edges.sparkSession)
    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both.write.parquet(f"{folder}/edges")
    both = spark.read.parquet(f"{folder}/edges")
    labels = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label"))
    for i in range(rounds):
        labels.write.parquet(f"{folder}/{i}")
        labels = spark.read.parquet(f"{folder}/{i}")
        near = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, "u").select("u", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("u").alias("label"), F.col("label").alias("far"))
        new = step.join(jump, "label").select("u", "old", F.least("label", "far").alias("label"))
        new.write.parquet(f"{folder}/new{i}")
        new = spark.read.parquet(f"{folder}/new{i}")
        labels = new.select("u", "label")
        for old in (f"{folder}/{i}", *([f"{folder}/new{i - 1}"] if i else [])):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if new.where("old <> label").isEmpty():
            break
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return labels.withColumnRenamed("u", "node")


def key_components(df: DataFrame, node: str, keys: Sequence[str]) -> DataFrame:
    """Rows that share any of the key columns are one component; a null key is shared with none.

    A key's rows form a star to the smallest, never all pairs.
    """
    edges = None
    for k in keys:
        held = df.where(F.col(k).isNotNull())
        star = held.groupBy(k).agg(F.min(node).alias("__least"))
        part = held.join(star, k).select("__least", F.col(node).alias("b")).withColumnRenamed("__least", "a")
        edges = part if edges is None else edges.unionByName(part)
    alone = df.select(F.col(node).alias("a"), F.col(node).alias("b"))
    return components(edges.unionByName(alone))


def assign_groups(groups: DataFrame, group: str, conflict: Column, preferred: Column) -> DataFrame:
    """Each group's split: the preferred one, or ``excluded`` where hashes conflict."""
    return groups.select(group, F.when(conflict, "excluded").otherwise(preferred).alias("split"))
