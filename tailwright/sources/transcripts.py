"""Reading transcript files and cursors."""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import reachable, read_range, store_settings, top_of, walk

ENDING = ".jsonl"
FILE = "file_path string, content binary, length long"
_FILE = pa.schema([("file_path", pa.string()), ("content", pa.binary()), ("length", pa.int64())])
CURSOR = "file_path string, bytes_uploaded long, lines_uploaded long, sha256_of_last_upload string, last_run_at string"


def list_transcripts(spark: SparkSession, root: str) -> DataFrame:
    """file_path and length of all files under ``root`` whose names end in .jsonl, but those without bytes, which have nothing to read; no content is read."""
    return _with_bytes(spark, root).drop("content")


def read_transcripts(spark: SparkSession, root: str) -> DataFrame:
    """All files under ``root`` whose names end in .jsonl, as file_path, content, length; none if it is missing.

    Names that begin with a dot or an underscore are hidden from Spark. A file is one row, of 2 GB at most;
    passes take ``list_transcripts``, of any size, and read byte ranges. A file that is gone since it was listed is left out; one
    that is there and breaks off fails its task, which is tried again, and in the end the job.
    """
    return _with_bytes(spark, root).unionByName(_without_bytes(spark, root))


def _with_bytes(spark: SparkSession, root: str) -> DataFrame:
    try:
        files = (
            spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{ENDING}")
            .option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "false").load(root)
        )
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FILE)
    return files.select(F.regexp_replace("path", "^file:(//)?", "").alias("file_path"), "content", "length")


def _without_bytes(spark: SparkSession, root: str) -> DataFrame:
    """The same of files without bytes, which Spark's readers leave out. Tasks list the folders of ``root``; those of stores that only Spark knows are listed by the driver."""
    settings, root = store_settings(spark), root.rstrip("/")
    if not reachable(root, settings):
        store, at = _hadoop(spark, root)
        found, more = [], [at] if store.exists(at) else []
        while more:
            for s in store.listStatus(more.pop()):
                if _hidden(s.getPath().getName()):
                    continue
                if s.isDirectory():
                    more.append(s.getPath())
                elif s.getLen() == 0 and s.getPath().getName().endswith(ENDING):
                    found.append((s.getPath().toString(), b"", 0))
        return spark.createDataFrame(found, FILE)
    folders, files = top_of(root, settings)
    own = [(p, b"", 0) for p, n in files if n == 0 and p.endswith(ENDING) and not _hidden(p.rsplit("/", 1)[-1])]
    folders = [(f,) for f in folders if not _hidden(f.rsplit("/", 1)[-1])]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                names = [p for p, n in walk(folder, ENDING, settings) if n == 0 and not any(map(_hidden, p[len(folder) :].split("/")))]
                yield pa.RecordBatch.from_pydict({"file_path": names, "content": [b""] * len(names), "length": [0] * len(names)}, schema=_FILE)

    tasks = max(1, min(len(folders), spark.sparkContext.defaultParallelism))
    below = spark.createDataFrame(folders, "folder string").repartition(tasks).mapInArrow(listed, FILE)
    return below.unionByName(spark.createDataFrame(own, FILE)) if own else below


def _hidden(name: str) -> bool:
    """Whether Spark's readers pass over a file or folder of this name."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def valid_cursors(cursors: DataFrame) -> DataFrame:
    """Rows with every field; damaged ones are dropped, so that their files are read from the start."""
    return cursors.dropna(subset=[c.split()[0] for c in CURSOR.split(", ")])


def load_cursors(spark: SparkSession, path: str) -> DataFrame:
    """The cursors stored at a path: the newest whole table with the whole deltas after it, of each file the newest row.

    Absent and unreadable ones are empty, damaged files are left out: what they said is read again, and found known.
    """
    whole = sorted(v for v, done in _versions(spark, path) if done)
    full = max((v for v in whole if not v.endswith(DELTA)), default="")
    use = [v for v in whole if v >= full]
    if not use:
        return spark.createDataFrame([], CURSOR)
    read = spark.read.schema(CURSOR).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    rows = valid_cursors(read.parquet(f"{path}/{use[0]}")).withColumn("version", F.lit(use[0]))
    for v in use[1:]:
        rows = rows.unionByName(valid_cursors(read.parquet(f"{path}/{v}")).withColumn("version", F.lit(v)))
    if len(use) == 1:
        return rows.drop("version")
    names = [c.split()[0] for c in CURSOR.split(", ")]
    return rows.groupBy("file_path").agg(F.max_by(F.struct(*names), "version").alias("newest")).select("newest.*")


def add_cursors(moved: DataFrame, path: str, most: int = 16) -> None:
    """Store the rows of moved cursors as a delta beside what there is: a pass writes what it moves.

    After ``most`` deltas all become one table, and what went before it goes; the tables count until the new one is whole.
    """
    spark = moved.sparkSession
    before = sorted(v for v, done in _versions(spark, path) if done)
    moved.select(*(c.split()[0] for c in CURSOR.split(", "))).write.parquet(f"{path}/{_next(spark, path)}{DELTA if before else ''}")
    if sum(v.endswith(DELTA) for v in before) >= most:
        save_cursors(load_cursors(spark, path), path)


def save_cursors(cursors: DataFrame, path: str) -> None:
    """Store a whole table beside the one before it, which counts until this one is whole; older ones go."""
    spark = cursors.sparkSession
    before = sorted(v for v, _ in _versions(spark, path))
    cursors.write.parquet(f"{path}/{_next(spark, path)}")
    full = max((v for v in before if not v.endswith(DELTA)), default="")
    for v in before:
        if v < full:
            store, at = _hadoop(spark, f"{path}/{v}")
            store.delete(at, True)


#: The end of the name of a table that holds moved cursors only.
DELTA = "-delta"


def _next(spark: SparkSession, path: str) -> str:
    return f"{max((int(v.split('-')[0]) for v, _ in _versions(spark, path)), default=0) + 1:012d}-{uuid.uuid4().hex[:8]}"


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def is_whole(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    store, at = _hadoop(spark, f"{path}/_SUCCESS")
    return store.exists(at)


def list_folders(spark: SparkSession, path: str) -> list[str]:
    store, at = _hadoop(spark, path)
    return [s.getPath().getName() for s in store.listStatus(at) if s.isDirectory()] if store.exists(at) else []


def drop_folder(spark: SparkSession, path: str) -> None:
    store, at = _hadoop(spark, path)
    store.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text; empty if there is none."""
    store, at = _hadoop(spark, path)
    if not store.exists(at):
        return ""
    stream = store.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str | None) -> None:
    """Put a small file in place of what is there; None: delete it."""
    store, at = _hadoop(spark, path)
    if text is None:
        store.delete(at, False)
        return
    stream = store.create(at, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def _versions(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """Names of the tables at a path, and whether each is whole."""
    store, at = _hadoop(spark, path)
    try:
        names = [s.getPath().getName() for s in store.listStatus(at) if s.isDirectory()] if store.exists(at) else []
        return [(n, store.exists(_hadoop(spark, f"{path}/{n}/_SUCCESS")[1])) for n in names if n[:12].isdigit()]
    except Py4JError:
        return []


def new_ranges(files: DataFrame, cursors: DataFrame, on_shrink: str = "restart") -> DataFrame:
    """file_path, start, end (the file's length) and lines_before of files with new bytes; only narrow rows meet.

    A file shorter than its cursor is read from the start again ("restart"), or left alone until it
    has grown past it ("skip").
    """
    if on_shrink not in ("restart", "skip"):
        raise ValueError(on_shrink)
    zero, size = F.lit(0).cast("long"), F.col("length").cast("long")
    at = F.coalesce("bytes_uploaded", zero)
    start = F.when(at > size, zero if on_shrink == "restart" else size).otherwise(at)
    before = F.when(at > size, zero).otherwise(F.coalesce("lines_uploaded", zero))
    joined = files.select("file_path", "length").join(cursors.select("file_path", "bytes_uploaded", "lines_uploaded"), "file_path", "left")
    return joined.select("file_path", start.alias("start"), size.alias("end"), before.alias("lines_before")).where("start < end")


LINES = "file_path string, start long, lines_before long, line_no long, byte_start long, byte_len long, raw string, sha256 string"
_NAMES = [c.split()[0] for c in LINES.split(", ")]
_KINDS = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.string()]
#: Bytes of a file that one task reads; a longer range is read in splits.
SPLIT_BYTES = 64 << 20
#: Ranges up to which their rows are broadcast to files that only Spark's readers reach.
BROADCAST_RANGES = 1_000_000


def _batch(*cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _KINDS, strict=True)], names=_NAMES)


def _lines_of(row: dict, blocks: Iterator[bytes], at: int, no: int, until: int | None = None, digest: bool = True) -> Iterator[pa.RecordBatch]:
    """The complete lines of blocks that begin at a line; those that begin before ``until``, if given; with a row of the range's end if ``digest``."""
    path, first, before = row["file_path"], row["start"], row["lines_before"]
    sha, held = hashlib.sha256(), []  # held: of a line whose end is not read yet
    for block in blocks:
        *whole, rest = block.split(b"\n")
        if whole:
            whole[0] = b"".join([*held, whole[0]])
            held = []
            if digest:
                sha.update(b"\n".join(whole) + b"\n")
            starts = [at]
            for x in whole:
                starts.append(starts[-1] + len(x) + 1)
            at = starts.pop()
            if until is not None:
                whole = whole[: bisect_left(starts, until)]
                starts = starts[: len(whole)]
            if k := len(whole):
                yield _batch([path] * k, [first] * k, [before] * k, range(no, no + k), starts, [len(x) for x in whole], [x.decode("utf-8", "replace") for x in whole], [None] * k)
            no += len(whole)
        held.append(rest)
        if until is not None and at >= until:
            return
    if digest and no:
        yield _batch([path], [first], [before], [no], [at], [None], [None], [sha.hexdigest()])


def _split_start(row: dict, settings: dict[str, str]) -> int | None:
    """Where the first line begins that begins in the split, if there is one."""
    low, high = row["low"], row["high"]
    if low == row["start"]:
        return low
    at = low - 1
    for block in read_range(row["file_path"], at, row["end"], settings):
        if (k := block.find(b"\n")) >= 0:
            return at + k + 1 if at + k + 1 < high else None
        at += len(block)
        if at >= high:
            return None
    return None


def _digest(row: dict, settings: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """The row of the end of a range that others read in splits; a digest goes through the bytes in order."""
    sha, no, at, tail = hashlib.sha256(), 0, row["start"], b""
    for block in read_range(row["file_path"], row["start"], row["end"], settings):
        k = block.rfind(b"\n") + 1
        if k:
            sha.update(tail)
            sha.update(memoryview(block)[:k])
            no += block.count(b"\n")
            at += len(tail) + k
            tail = block[k:]
        else:
            tail += block
    if no:
        yield _batch([row["file_path"]], [row["start"]], [row["lines_before"]], [no], [at], [None], [None], [sha.hexdigest()])


def _reading(settings: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                path, first = row["file_path"], row["start"]
                try:
                    if row["part"] == "whole":
                        yield from _lines_of(row, read_range(path, first, row["end"], settings), first, 0)
                    elif row["part"] == "digest":
                        yield from _digest(row, settings)
                    elif (at := _split_start(row, settings)) is not None:
                        yield from _lines_of(row, read_range(path, at, row["end"], settings), at, row["lines_ahead"], row["high"], False)
                except FileNotFoundError:
                    pass  # gone since it was listed

    return run


def _counting(settings: dict[str, str]):
    """How many lines begin in each split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = 0
                try:
                    if (at := _split_start(row, settings)) is not None:
                        # the newline ahead of each line but the first lies before the split's end
                        n = 1 + sum(b.count(b"\n") for b in read_range(row["file_path"], at, row["high"] - 1, settings))
                except FileNotFoundError:
                    pass
                yield pa.RecordBatch.from_pydict({"file_path": [row["file_path"]], "start": [row["start"]], "low": [row["low"]], "lines": [n]})

    return run


def _from_content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k].as_py() for c in ("file_path", "start", "end", "lines_before")}
            content = memoryview(batch.column("content")[k].as_buffer())[row["start"] : row["end"]]
            yield from _lines_of(row, (bytes(content[i : i + (1 << 20)]) for i in range(0, len(content), 1 << 20)), row["start"], 0)


def _scheme():
    """Scheme and authority of a path; empty for a local one."""
    return F.regexp_extract("file_path", "^([A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?)", 1)


def read_lines(ranges: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The complete lines of byte ranges, as ``LINES``, read in blocks where they lie, without a shuffle of payload.

    ``line_no`` counts from 0 in the range, ``byte_start`` in the file. One more row for each range with a line, with null raw, has
    the sha256 of exactly the bytes of its lines, their number as line_no and their end as byte_start.
    Bytes behind the last newline are still being written and are left out; invalid UTF-8 becomes U+FFFD.

    A range of over ``split_bytes`` is read in splits, each with the lines that begin in it; what comes before is numbered by
    counts of all splits ahead. Tasks are dealt by bytes. Files in stores that workers cannot open are read by Spark, whole (of 2 GB at most).
    """
    spark = ranges.sparkSession
    settings = store_settings(spark)
    ranges = ranges.select("file_path", "start", "end", "lines_before")
    schemes = [r.s for r in ranges.select(_scheme().alias("s")).distinct().collect()]
    others = [s for s in schemes if s and not reachable(f"{s}/x", settings)]
    own = ranges.where(~_scheme().isin(others)) if others else ranges
    lines = _lines_in_splits(own, split_bytes, settings)
    return lines.unionByName(_lines_by_spark(ranges.where(_scheme().isin(others)))) if others else lines


def _lines_in_splits(ranges: DataFrame, split_bytes: int, settings: dict[str, str]) -> DataFrame:
    spark = ranges.sparkSession
    size = F.col("end") - F.col("start")
    total, longest = ranges.agg(F.sum(size), F.max(size)).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // split_bytes))
    none = F.lit(None).cast("long")
    wanted = ranges.where(size <= split_bytes).select("*", none.alias("low"), none.alias("high"), F.lit("whole").alias("part"), none.alias("lines_ahead"))
    if (longest or 0) > split_bytes:
        long = ranges.where(size > split_bytes)
        low = F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(split_bytes).cast("long")))
        splits = long.withColumn("low", low).withColumn("high", F.least(F.col("low") + split_bytes, "end"))
        counted = splits.repartition(tasks).mapInArrow(_counting(settings), "file_path string, start long, low long, lines long")
        ahead = Window.partitionBy("file_path", "start").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
        numbered = counted.withColumn("lines_ahead", F.coalesce(F.sum("lines").over(ahead), F.lit(0))).drop("lines")
        wanted = wanted.unionByName(splits.join(numbered, ["file_path", "start", "low"]).withColumn("part", F.lit("split")))
        wanted = wanted.unionByName(long.select("*", none.alias("low"), none.alias("high"), F.lit("digest").alias("part"), none.alias("lines_ahead")))
    return wanted.repartition(tasks).mapInArrow(_reading(settings), LINES)


def _lines_by_spark(ranges: DataFrame) -> DataFrame:
    """The same of files in stores that only Spark's readers know: these give whole files."""
    spark = ranges.sparkSession
    paths = [r.file_path for r in ranges.select("file_path").distinct().collect()]
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(paths).select(F.col("path").alias("file_path"), "content")
    met = F.broadcast(ranges) if len(paths) <= BROADCAST_RANGES else ranges
    return files.join(met, "file_path").mapInArrow(_from_content, LINES)


def slice_at_cursor(files: DataFrame, cursors: DataFrame, on_shrink: str = "restart") -> DataFrame:
    """file_path, content past the cursor, start, lines_before; files with nothing new drop out.

    A file shorter than its cursor is read from the start again ("restart"), or left alone until it
    has grown past it ("skip").
    """
    sized = files.select("file_path", F.col("content").cast("binary").alias("content")).withColumn("length", F.octet_length("content").cast("long"))
    # narrow rows decide; contents then meet only those of files with something new
    ranges = new_ranges(sized, cursors, on_shrink)
    return sized.join(ranges, "file_path").select("file_path", F.expr("substring(content, CAST(start AS INT) + 1)").alias("content"), "start", "lines_before")
