"""What the operators share: tables, the shared work folder, shipping the code."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship as send_code

#: Words everywhere: maximal runs of characters other than space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
READER_SETTING = "spark.sql.parquet.columnarReaderBatchSize"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _unless_set(spark: SparkSession, name: str, value: str) -> None:
    if spark.conf.get(name) == spark._jvm.org.apache.spark.sql.internal.SQLConf().getConfString(name):
        spark.conf.set(name, value)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, and bound batches between Spark and Python by bytes.

    Rows here are whole texts, and a batch is held several times over: in Spark's
    vectors, in the buffer to or from Python, and there. A setting of the user's stays.
    """
    _unless_set(spark, BATCH_SETTING, "2m")
    send_code(spark)


def read_few(spark: SparkSession) -> None:
    """Let Parquet readers give 256 rows at once, not 4,096; a setting of the user's stays.

    A text column grows by doubling, so 4,096 long texts leave several times
    their size as garbage. It holds for the session's later queries too.
    """
    _unless_set(spark, READER_SETTING, "256")


class Workspace:
    """A fresh folder below ``spark.checkpoint.dir`` for tables that cut lineage.

    The setting is read from the session; where it is unset, a temporary folder
    is made if the whole of Spark is this one process, and else ValueError is
    raised: no executor would see another's files. The JVM removes the folder at
    its exit, and ``drop`` removes one table as soon as nothing reads it.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            sc = spark.sparkContext
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            if not getattr(sc, "_millrace_local", None):
                sc._millrace_local = tempfile.mkdtemp(prefix="millrace")
            base = sc._millrace_local
        self.path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        path = self._hadoop(self.path)
        fs = path.getFileSystem(self._conf)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def put(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write ``df`` as Parquet and return the written table. A writer holds a row group, so these are small."""
        at = f"{self.path}/{name}"
        df.write.options(**{"compression": "zstd", "parquet.block.size": str(32 << 20), **options}).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        path = self._hadoop(f"{self.path}/{name}")
        path.getFileSystem(self._conf).delete(path, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def as_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


#: Id tables up to this many rows (some MB) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 400_000


def pick(rows: DataFrame, ids: DataFrame, keys: list[str], how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` joined with a narrow written table ``ids``, broadcast only after its size is checked.

    So a small table spares the shuffle of whole texts, and a large one costs one.
    """
    small = ids.limit(most + 1).count() <= most
    return rows.join(F.broadcast(ids) if small else ids, keys, how)


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle files whose DataFrames are gone.

    Its cleaner follows the driver's garbage collection, which a phase with
    small driver objects may not cause for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
