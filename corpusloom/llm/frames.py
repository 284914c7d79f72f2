"""What the operators of this subpackage share on the Spark side."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bounds what a Python worker holds at once: long texts come few at a time.  Results are lazy, so the bound outlives the call; a
    smaller one that the session has already stays."""
    now = int(spark.conf.get(BATCH, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(BATCH, str(rows))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column, counted in one pass over it."""
    return int(df.agg(F.sum(F.octet_length(F.col(column).cast("string")).cast("long"))).first()[0] or 0)


def buckets(size: int, each: int, least: int = 12) -> int:
    """How many parts of `each` bytes `size` measured bytes have."""
    return max(least, -(-size // each))


def shared_folder(spark: SparkSession) -> str:
    """The reliable folder for checkpoints: spark.checkpoint.dir, or what the session was given.  A local session may do without: it has one machine."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "corpusloom-checkpoints")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Frames made inside give up their shuffle files once they have run; for frames that are written or checkpointed at once."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


def cut(df: DataFrame, files: int | None = None) -> DataFrame:
    """The frame, written to the reliable checkpoint folder, its lineage ended and its shuffle files gone.

    A checkpoint has a file for each partition, empty ones too, and on a local disk Hadoop starts two processes for each; `files`, which should
    grow with the input, is the most that it gets."""
    spark = df.sparkSession
    shared_folder(spark)
    with shuffles_removed(spark):
        return (df.select("*") if files is None else df.coalesce(files)).checkpoint(eager=True)


class Written:
    """A frame as a table in the shared folder, which goes when its successor stands."""

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        self.path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
        with shuffles_removed(spark):
            df.select("*").write.option("compression", "none").parquet(self.path)
        self.frame = spark.read.schema(df.schema).parquet(self.path)

    def remove(self) -> None:
        session = self.frame.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(column):
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
