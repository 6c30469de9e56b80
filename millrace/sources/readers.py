"""Readers: each returns DataFrames of a declared schema; bad rows come as a frame of rejects."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.validate import require, unique_gate

Schema = T.StructType | str


def jsonl(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """Lenient: blank lines are passed over, a broken line gives nulls."""
    return spark.read.schema(schema).json(path)


def jsonl_strict(spark: SparkSession, path: str, schema: Schema, blank_is_bad: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects(file, value, reason)): broken lines, roots that aren't objects and, if asked, blank lines."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    blank = F.trim("value") == ""
    tree = F.try_parse_json("value")
    reason = F.when(blank, F.lit("blank") if blank_is_bad else F.lit(None)).when(tree.isNull(), "not_json").when(~F.trim("value").startswith("{"), "not_an_object")
    judged = lines.withColumn("reason", reason)
    rows = judged.where(~blank & F.col("reason").isNull()).select(F.from_json("value", schema).alias("r")).select("r.*")
    return rows, judged.where("reason IS NOT NULL")


def json_document(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """One document: an object is a row, a list gives a row an element. One file is one task; split large ones first."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def parquet_columns(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Only the named columns reach the scan."""
    return spark.read.parquet(*paths).select(*columns)


def parquet_recursive(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).parquet(root)


def manifest(spark: SparkSession, path: str, episode: Schema, schema_id: str, renames: dict[str, str], parts: bool = False) -> DataFrame:
    """Episodes of one manifest document of a known schema id, public variant names made internal.

    With ``parts`` the manifest may be split into several documents, all of that schema id.
    """
    kind = episode if isinstance(episode, str) else episode.simpleString().removeprefix("struct<").removesuffix(">")
    doc = json_document(spark, path, f"schema_id string, frozen boolean, episodes array<struct<{kind}>>")
    ids = doc.select("schema_id")
    head = (ids.distinct() if parts else ids).limit(2).collect()
    if [r.schema_id for r in head] != [schema_id]:
        raise ValueError(f"the manifest's schema is {[r.schema_id for r in head]}, not {schema_id}")
    names = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv]) if renames else None
    rows = doc.select("frozen", F.explode("episodes").alias("e")).select("frozen", "e.*")
    return rows if names is None else rows.withColumn("variant", F.coalesce(names[F.col("variant")], F.col("variant")))


def complete_records(spark: SparkSession, pattern: str, schema: Schema) -> DataFrame:
    """Records whose status is complete; unreadable files are passed over."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(pattern).where("record_status = 'complete'")


def shard_records(spark: SparkSession, pattern: str, schema: Schema) -> DataFrame:
    """Complete records with the number of the shard folder that they come from."""
    rows = spark.read.schema(schema).json(pattern).select("*", F.regexp_extract("_metadata.file_path", r"shard_(\d+)", 1).cast("int").alias("shard"))
    return rows.where("record_status = 'complete'")


def ids(spark: SparkSession, path: str) -> DataFrame:
    """One id a line; a repeated one is an error."""
    rows = spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")
    require(unique_gate(rows, ["id"]))
    return rows


_BY_SUFFIX: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    ".parquet": lambda s, p: s.read.parquet(p),
    ".jsonl": lambda s, p: s.read.json(p),
    ".json": lambda s, p: s.read.option("multiLine", True).json(p),
}


def mixed(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Files of several kinds, by suffix, one below the other; missing columns are null."""
    out = None
    for p in paths:
        suffix = next((s for s in (".parquet", ".jsonl", ".json") if p.endswith(s)), None)
        if suffix is None:
            raise ValueError(f"no reader for {p}")
        part = _BY_SUFFIX[suffix](spark, p)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files")
    return out


# --- grounding samples: (benchmark, id, instruction, x1, y1, x2, y2, polygon) ---


def _sample(df: DataFrame, name: str, box: Sequence, polygon=None) -> DataFrame:
    cols = [b.cast("double").alias(n) for b, n in zip(box, ("x1", "y1", "x2", "y2"))]
    poly = F.lit(None).cast("array<struct<x:double,y:double>>") if polygon is None else polygon
    return df.select(F.lit(name).alias("benchmark"), "id", "instruction", *cols, poly.alias("polygon"))


def bench_xyxy(df: DataFrame, name: str) -> DataFrame:
    b = F.col("bbox")
    return _sample(df, name, [b[0], b[1], b[2], b[3]])


def bench_xywh(df: DataFrame, name: str) -> DataFrame:
    b = F.col("bbox")
    return _sample(df, name, [b[0], b[1], b[0] + b[2], b[1] + b[3]])


def bench_normalized(df: DataFrame, name: str) -> DataFrame:
    """Boxes in 0..1 of the image's size."""
    b, s = F.col("bbox"), F.col("image_size")
    return _sample(df, name, [b[0] * s[0], b[1] * s[1], b[2] * s[0], b[3] * s[1]])


def bench_polygon(df: DataFrame, name: str) -> DataFrame:
    """By box_type: a box as x, y, width, height, or a polygon as flat pairs."""
    b = F.col("box")
    is_box = F.col("box_type") == "bbox"
    pts = F.transform(F.sequence(F.lit(0), (F.size(b) / 2 - 1).cast("int")), lambda i: F.struct(b[i * 2].alias("x"), b[i * 2 + 1].alias("y")))
    edge = lambda v: F.when(is_box, v)
    return _sample(df, name, [edge(b[0]), edge(b[1]), edge(b[0] + b[2]), edge(b[1] + b[3])], F.when(~is_box, pts))


LOADERS: dict[str, Callable[[DataFrame, str], DataFrame]] = {"pro": bench_xyxy, "v2": bench_xywh, "mm": bench_normalized, "uiv": bench_xyxy, "osw": bench_polygon}


def load_bench(df: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    if name not in LOADERS:
        raise ValueError(f"unknown benchmark {name}")
    out = LOADERS[name](df, name)
    return out if limit is None else out.orderBy("id").limit(limit)


# --- archives ---


def tar_members(spark: SparkSession, pattern: str, most_bytes: int = 64 << 20, most_members: int = 1_000_000) -> DataFrame:
    """(archive, name, size, content) of the files in tar archives.

    A member with an absolute or climbing path, or an archive beyond the limits,
    is an error, not a silent loss.
    """

    def run(batches):
        for p in batches:
            for path, content in zip(p["path"], p["content"]):
                rows = []
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for n, m in enumerate(tar):
                        parts = m.name.split("/")
                        if m.name.startswith("/") or ".." in parts or n >= most_members or m.size > most_bytes:
                            raise ValueError(f"{path}: member {m.name!r} isn't allowed")
                        if m.isfile():
                            rows.append((path, m.name, m.size, tar.extractfile(m).read()))
                yield pd.DataFrame(rows, columns=["archive", "name", "size", "content"])

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(run, "archive string, name string, size long, content binary")
