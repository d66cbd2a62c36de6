"""Reading, checkpoints and Arrow batches, shared by the operators of this package."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The same six characters.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run on this machine."""
    sc = spark.sparkContext
    if (at := sc._jsc.sc().getCheckpointDir()).isDefined():
        return at.get()
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="siltsieve-checkpoint-")
    sc.setCheckpointDir(at)
    return sc._jsc.sc().getCheckpointDir().get()


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_one_at_a_time = threading.Lock()
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; a lost executor loses nothing of it.

    Its shuffle files go as soon as it is kept, not when the driver next collects garbage: nothing reads them again.
    """
    spark = df.sparkSession
    shared_dir(spark)
    with _one_at_a_time:  # the setting is the session's, and threads may share it
        before = spark.conf.get(_FREE, None)
        spark.conf.set(_FREE, "true")
        try:
            return df.select("*").checkpoint()  # a plan of its own, made under the setting
        finally:
            spark.conf.set(_FREE, before) if before is not None else spark.conf.unset(_FREE)


def blocks(batch: pa.RecordBatch, text: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch with at most so many bytes of text each, or one row."""
    n = batch.num_rows
    if not n:
        return
    at = batch.column(batch.schema.get_field_index(text))
    size = pc.binary_length(at).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
    start = 0
    while start < n:
        before = int(size[start - 1]) if start else 0
        end = max(start + 1, int(size.searchsorted(before + most_bytes, "right")))
        yield batch.slice(start, end - start)
        start = end
    give_back()


def give_back() -> None:
    """Returns freed memory of a Python worker to the machine, as workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def lower_ascii(c):
    """A-Z lowered, nothing else changed."""
    return F.translate(c, UPPER, LOWER)
