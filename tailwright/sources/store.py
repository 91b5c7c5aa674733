"""The stored records, dealt into buckets by their keys, with a sketch of the keys of every file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .transcripts import read_text, write_text

STORE = "record_key string, uuid string, session_id string, project_path string, file_path string, byte_start long, record string"
STORED = f"{STORE}, bucket int"
SKETCH = "file string, bucket int, bits binary"
BUCKETS = 64
#: Bits of a sketch for each key, and probes of a key: one key in 400 is looked up in a file that does not have it.
KEY_BITS, PROBES = 16, 4
#: Rows of a bucket that one file of a pass has.
FILE_ROWS = 500_000
#: Keys of a bucket that one task probes.
GROUP = 1_000_000
#: Keys that are broadcast to the files that may hold them; more are joined by a shuffle of both.
BROADCAST_KEYS = 2_000_000

Keep = Callable[[DataFrame | Callable[[], DataFrame], str], DataFrame]


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def stored_records(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, STORE).select(*(c.split()[0] for c in STORE.split(", ")))


def buckets_of(spark: SparkSession, path: str, buckets: int = BUCKETS) -> int:
    """Into how many buckets a store is dealt: what its first pass was told holds for all."""
    told = read_text(spark, f"{path}-buckets")
    if not told:
        write_text(spark, f"{path}-buckets", told := str(buckets))
    return int(told)


def append_records(rows: DataFrame, path: str, count: int, buckets: int = BUCKETS) -> None:
    """Add rows (so many) as ``STORE`` says: of one pass a bucket gets one file for each half million rows or so."""
    buckets = buckets_of(rows.sparkSession, path, buckets)
    bucket = F.pmod(F.xxhash64("record_key"), F.lit(buckets)).cast("int")
    rows = rows.select(*(c.split()[0] for c in STORE.split(", ")), bucket.alias("bucket"))
    parts = F.pmod(F.xxhash64("record_key", F.lit(1)), F.lit(1 + count // (buckets * FILE_ROWS)))
    rows.repartition("bucket", parts).sortWithinPartitions("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def _probes(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Places of keys in a sketch of ``size`` (a power of two) bits."""
    h = hashes.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        yield ((h + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64)


def sketch(hashes: np.ndarray) -> bytes:
    size = 1 << max(10, int(len(hashes) * KEY_BITS - 1).bit_length())
    bits = np.zeros(size, bool)
    for p in _probes(hashes, size):
        bits[p] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_hold(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    packed = np.frombuffer(bits, np.uint8)
    found = np.ones(len(hashes), bool)
    for p in _probes(hashes, len(packed) * 8):
        found &= (packed[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
    return found


def _sketch_of_file(rows: pa.Table) -> pa.Table:
    bits = sketch(rows["h"].to_numpy())
    return pa.table({"file": rows["file"][:1].combine_chunks(), "bucket": rows["bucket"][:1].combine_chunks(), "bits": pa.array([bits], pa.binary())})


def sketches(spark: SparkSession, path: str) -> DataFrame | None:
    """The sketches of all files of a store, None without any record; files without a sketch, as after a crash, get theirs first."""
    at, have = f"{path}-sketches", read_or_empty(spark, f"{path}-sketches", SKETCH)
    try:
        files = spark.read.schema(STORED).parquet(path).inputFiles()
    except AnalysisException:
        files = []
    if not files:
        return None
    name = lambda f: F.concat_ws("/", F.element_at(F.split(f, "/"), -2), F.element_at(F.split(f, "/"), -1))
    there = spark.createDataFrame([(f,) for f in files], "uri string").withColumn("file", name(F.col("uri")))
    missing = [r.uri for r in there.join(have, "file", "left_anti").collect()]
    if missing:
        keys = spark.read.schema(STORED).option("basePath", path).parquet(*missing).select(name(F.col("_metadata.file_path")).alias("file"), "bucket", F.xxhash64("record_key").alias("h"))
        keys.groupBy("file", "bucket").applyInArrow(_sketch_of_file, SKETCH).write.mode("append").parquet(at)
        have = read_or_empty(spark, at, SKETCH)
    return have.join(there, "file", "left_semi").dropDuplicates(["file"])


def _probing(_, keys: pa.Table, files: pa.Table) -> pa.Table:
    out = []
    hashes = keys["h"].to_numpy() if keys.num_rows else np.zeros(0, np.int64)
    for file, bits in zip(files["file"].to_pylist(), files["bits"].to_pylist(), strict=True):
        hit = keys.filter(pa.array(may_hold(bits, hashes)))
        out.append(pa.table({"record_key": hit["record_key"], "file": pa.array([file] * hit.num_rows, pa.string())}))
    return pa.concat_tables(out) if out else pa.table({"record_key": pa.array([], pa.string()), "file": pa.array([], pa.string())})


def known_keys(keys: DataFrame, path: str, keep: Keep, buckets: int = BUCKETS) -> DataFrame:
    """Those of the distinct ``keys(record_key)`` that the store has.

    The keys meet the sketches of their bucket; only files that may hold one are read, and of these the keys. As long as those keys are few, they are
    broadcast, and nothing of the store is shuffled.
    """
    spark = keys.sparkSession
    have = sketches(spark, path)
    if have is None:
        return keys.limit(0)
    buckets = buckets_of(spark, path, buckets)
    hashed = keys.select("record_key", F.xxhash64("record_key").alias("h")).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    parts = max(1, -(-keys.count() // (GROUP * buckets)))
    hashed = hashed.withColumn("sub", F.pmod(F.xxhash64("h"), F.lit(parts)).cast("int"))
    spread = have.withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    probed = hashed.groupBy("bucket", "sub").cogroup(spread.groupBy("bucket", "sub")).applyInArrow(_probing, "record_key string, file string")
    suspects = keep(probed, "suspects")
    files = [r.file for r in suspects.select("file").distinct().collect()]
    if not files:
        return keys.limit(0)
    wanted = suspects.select("record_key").distinct()
    few = wanted.count() <= BROADCAST_KEYS
    stored = spark.read.schema(STORED).option("basePath", path).parquet(*(f"{path}/{f}" for f in files)).select("record_key")
    return stored.join(F.broadcast(wanted) if few else wanted, "record_key", "left_semi").distinct()
