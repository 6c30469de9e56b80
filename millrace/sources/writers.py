"""Writers: fixed schemas, gates before publishing, publishing by rename."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.validate import require


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line, nulls kept. Spark's commit makes it whole or absent."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def jsonl_text(df: DataFrame, group: Column, order: str) -> DataFrame:
    """Each group's rows as one JSONL text; groups must be of a bounded size, such as ranges of the order."""
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r")))), lambda x: x.r)
    return df.groupBy(group).agg(F.array_join(lines, "\n").alias("text"))


def checked(df: DataFrame, path: str, gates: DataFrame, fmt: str = "json") -> None:
    """Nothing is written unless the gates have no bad row and the folder is new."""
    require(gates)
    df.write.mode("errorifexists").format(fmt).save(path)


def parquet(df: DataFrame, path: str, schema: T.StructType | None = None) -> int:
    """zstd Parquet of the given schema; an empty table is an error. Returns the rows written."""
    if schema is not None:
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in schema])
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    n = df.sparkSession.read.parquet(path).count()
    if not n:
        raise ValueError("there is nothing to write")
    return n


def partitioned(df: DataFrame, path: str, by: str, expected: dict[str, int] | None = None) -> DataFrame:
    """A folder for each value of ``by``; the written counts must be the expected ones."""
    df.write.mode("errorifexists").partitionBy(by).parquet(path)
    counts = df.sparkSession.read.parquet(path).groupBy(by).agg(F.count("*").alias("n"))
    if expected is not None:
        found = {r[by]: r.n for r in counts.collect()}
        if found != expected:
            raise ValueError(f"wrote {found}, expected {expected}")
    return counts


def rewrite(df: DataFrame, path: str, index: str, images: str, root: str) -> DataFrame:
    """Shards as one table: the running index must have no gap, image paths get a root."""
    ends = df.agg(F.count("*").alias("n"), F.countDistinct(index).alias("d"), F.min(index).alias("low"), F.max(index).alias("high"))
    bad = ends.select(F.lit("row_index").alias("rule"), ((F.col("n") != F.col("d")) | (F.col("low") != 0) | (F.col("high") != F.col("n") - 1)).cast("long").alias("n_bad"))
    require(bad)
    df.withColumn(images, F.transform(images, lambda x: F.concat(F.lit(root + "/"), x))).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def json_file(spark: SparkSession, value: dict, path: str) -> None:
    """One small sorted JSON document, written aside and renamed."""
    bytes_file(spark, json.dumps(value, sort_keys=True, indent=1).encode(), path)


def bytes_file(spark: SparkSession, data: bytes, path: str) -> None:
    """One small file, written aside and renamed."""
    fs, target, Path = _fs(spark, path)
    aside = Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(data)
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(aside, target):
        raise OSError(f"can't rename to {path}")


def release(spark: SparkSession, path: str, tables: dict[str, DataFrame], summary: Callable[[dict[str, DataFrame]], dict], checks: Sequence[Callable[[dict[str, DataFrame]], DataFrame]] = ()) -> dict:
    """Write tables into a folder aside, check what was written, then publish by one rename.

    Each check gives gates over the written tables; a bad one removes the folder
    and nothing is published.
    """
    fs, target, Path = _fs(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    aside = f"{path}.{uuid.uuid4().hex}"
    try:
        for name, df in tables.items():
            df.write.option("compression", "zstd").parquet(f"{aside}/{name}")
        written = {n: spark.read.parquet(f"{aside}/{n}") for n in tables}
        for check in checks:
            require(check(written))
        facts = summary(written)
        json_file(spark, facts, f"{aside}/summary.json")
        if not fs.rename(Path(aside), target):
            raise OSError(f"can't publish {path}")
    except BaseException:
        fs.delete(Path(aside), True)
        raise
    return facts


def cached(df: DataFrame, cache: DataFrame, key: str, value: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, value): from the cache where the key is there, else computed."""
    have = cache.select(key, value).dropDuplicates([key])
    hit = df.select(key).distinct().join(have, key)
    miss = df.join(have.select(key), key, "left_anti")
    return hit.unionByName(compute(miss).select(key, value))
