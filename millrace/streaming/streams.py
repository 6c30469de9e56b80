"""Streams over a folder of records, run to the end of what is there.

``run`` drives a stream with ``availableNow``; each micro-batch goes to a folder
of its own, so a repeated batch replaces itself and the result is exactly once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dedup import shared_folder


def events(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """The records of a Parquet file or folder as a stream."""
    schema = spark.read.parquet(path).schema
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():  # a source must be a folder
        return stream.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return stream.parquet(path)


def run(stream: DataFrame, mode: str = "append", last: str | None = None) -> DataFrame:
    """The stream's output so far, as a table.

    In complete mode only the newest batch counts; in update mode the newest row
    of each ``last`` key does.
    """
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)
    schema = T.StructType([T.StructField("batch", T.LongType()), *stream.schema])

    def put(df: DataFrame, i: int) -> None:
        df.select(F.lit(i).cast("long").alias("batch"), "*").write.mode("overwrite").parquet(f"{folder}/out/b{i}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    out = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/out") if q.lastProgress else spark.createDataFrame([], schema)
    if mode == "complete":
        newest = out.agg(F.max("batch").alias("batch"))
        out = out.join(F.broadcast(newest), "batch")
    elif mode == "update" and last:
        rows = F.struct("batch", *[c for c in out.columns if c not in ("batch", last)])
        out = out.groupBy(last).agg(F.max_by(rows, "batch").alias("r")).select(last, "r.*")
    return out.drop("batch")


PROGRESS = "episode long, steps long, longest long, swings long, over boolean"
STATE = "steps long, longest long, swings long, run long, recent string"


def progress(stream: DataFrame, budget: int) -> DataFrame:
    """Per episode, over all its steps so far: steps, longest repetition, A-B-A-B swings, budget exceeded.

    ``stream(episode, id, variant)``; the steps of a batch are taken in order of
    id, and the state carries the run and the last three actions to the next.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        steps, longest, swings, run_, recent = state.get if state.exists else (0, 0, 0, 0, "")
        seen = recent.split("\x1f") if recent else []
        rows = pd.concat(list(frames)).sort_values("id")
        for v in rows["variant"]:
            run_ = run_ + 1 if seen and seen[-1] == v else 1
            longest = max(longest, run_)
            if len(seen) >= 3 and seen[-2] == v and seen[-3] == seen[-1] and seen[-1] != v:
                swings += 1
            seen = [*seen[-2:], v]
            steps += 1
        state.update((steps, longest, swings, run_, "\x1f".join(seen)))
        yield pd.DataFrame([(key[0], steps, longest, swings, steps > budget)], columns=["episode", "steps", "longest", "swings", "over"])

    return stream.groupBy("episode").applyInPandasWithState(step, PROGRESS, STATE, "update", "NoTimeout")


def machine(stream: DataFrame, click: str, end: str, limit: int) -> DataFrame:
    """Per episode a click/terminate machine: clicks until the first end, closed by it or by the limit."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        clicks, status = state.get if state.exists else (0, "open")
        rows = pd.concat(list(frames)).sort_values("id")
        for v in rows["variant"]:
            if status != "open":
                break
            if v == end:
                status = "ended"
            elif v == click:
                clicks += 1
                if clicks >= limit:
                    status = "limit"
        state.update((clicks, status))
        yield pd.DataFrame([(key[0], clicks, status)], columns=["episode", "clicks", "status"])

    return stream.groupBy("episode").applyInPandasWithState(step, "episode long, clicks long, status string", "clicks long, status string", "update", "NoTimeout")
