"""Shared helpers: tables, the shared work folder, memory of workers, small hashing utilities."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of text that a Python worker works on at once. Spark's own batches are bounded by
#: ``spark.sql.execution.arrow.maxBytesPerBatch`` (64 MB, see ``small_batches``) and 10,000 rows.
BATCH_ROWS = 500
BATCH_BYTES = 12 << 20
#: Bytes of a batch on its way to a Python worker. Buffers of many megabytes are no part of the executor's pool: every
#: thread allocates them anew, and what is freed stays with the thread.
ARROW_BYTES = 4 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], column: str | None = "text", rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batches of at most so many rows and, but for a single long text, bytes in ``column`` (None: rows only)."""
    give_back()  # what the worker's last task held
    for batch in batches:
        if column is None:
            yield from (batch.slice(s, rows) for s in range(0, batch.num_rows, rows))
            continue
        text = batch.column(column)
        wide = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
        at = np.frombuffer(text.buffers()[1], wide)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, wide)
        s = 0
        while s < batch.num_rows:
            e = min(s + rows, batch.num_rows, max(s + 1, int(np.searchsorted(at, at[s] + size, side="right")) - 1))
            yield batch.slice(s, e - s)
            s = e


def small_batches(spark: SparkSession) -> None:
    """From now on the session's batches for Python workers have ``ARROW_BYTES`` at most, but for a single long row; a smaller bound stays."""
    have = int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch())
    if not 0 < have <= ARROW_BYTES:
        spark.conf.set(_ARROW, str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Where neither that setting nor a checkpoint directory is set, a temporary folder becomes the
    checkpoint directory if everything runs in one process, as in local tests; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def parts_of(df: DataFrame, size: int = 64 << 20) -> int:
    """Partitions of about ``size`` bytes by the planner's estimate, as many as the session's shuffle partitions at least."""
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(estimate) // size, 1_000_000))


class Workspace:
    """Tables written to the shared folder, to cut lineage: they outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Hand free memory back to the machine: a worker that has held much lives on for other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 5."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer over an unsigned array (vectorized, wraps)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """bytes -> 64-bit hash, remembered for up to ``limit`` words of a worker."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h
