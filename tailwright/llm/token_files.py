"""Token ids as flat binary files with 64-bit document offsets, written and read by tasks.

A folder holds, for each part ``p`` in the order of doc_id: ``p.bin``, the ids as little-endian
unsigned integers (two bytes where the vocabulary allows it, else four); ``p.off``, little-endian
signed 64-bit positions, in ids from the start of the whole corpus, of each document and of the
part's end; ``p.ids``, the documents' ids; and one ``format.json``. Document ``k`` of a part
is ``bin[off[k] - off[0] : off[k + 1] - off[0]]``.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import place as _place
from .common import Workspace, parts_of, pieces
from .tokens import SLICE, encoder

END_ID = 2


def _publish(uri: str, chunks: Iterator[bytes]) -> None:
    """Write under a name of this attempt, then move: a repeated task leaves one whole file."""
    at, path = _place(uri)
    task = TaskContext.get()
    mine = f"{path}.{task.taskAttemptId() if task else 'driver'}"
    with at.open_output_stream(mine) as out:
        for c in chunks:
            out.write(c)
    at.move(mine, path)


def open_ints(uri: str, dtype: str) -> np.ndarray:
    """The file's integers: memory-mapped where it is local, else read in one piece."""
    at, path = _place(uri)
    if not at.get_file_info(path).size:
        return np.zeros(0, dtype)
    if isinstance(at, fs.LocalFileSystem):
        return np.memmap(path, dtype, mode="r")
    with at.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def _write(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, drops_space=False)
        part = f"part-{TaskContext.get().partitionId():06d}"
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []

        def chunks() -> Iterator[bytes]:
            for batch in pieces(batches, rows=10_000, size=SLICE):
                got, at = coder.encode_flat(batch.column("text"))
                ids.append(batch.column("doc_id").to_numpy())
                lengths.append(np.diff(at) + 1)
                yield np.insert(got, at[1:], end_id).tobytes()

        _place(folder)[0].create_dir(_place(folder)[1], recursive=True)
        _publish(f"{folder}/{part}.bin", chunks())
        if ids:
            docs, tokens = sum(map(len, ids)), int(sum(n.sum() for n in lengths))
            _publish(f"{folder}/{part}.ids", (i.astype("<i8").tobytes() for i in ids))
            _publish(f"{folder}/{part}.len", (n.astype("<i8").tobytes() for n in lengths))
            yield pa.RecordBatch.from_pydict({"part": [part], "docs": [docs], "tokens": [tokens], "bytes_each": [coder.dtype.itemsize]})

    return run


def _offsets(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist(), strict=True):
                at = np.concatenate([[0], np.cumsum(open_ints(f"{folder}/{part}.len", "<i8"))]) + base
                _publish(f"{folder}/{part}.off", iter([at.astype("<i8").tobytes()]))
                where, path = _place(f"{folder}/{part}.len")
                if int(at[-1]) - base >= 0 and where.get_file_info(path.removesuffix(".len") + ".off").size:
                    yield pa.RecordBatch.from_pydict({"part": [part], "docs": [len(at) - 1]})

    return run


def _parts(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """One task for each part."""
    df = spark.createDataFrame(rows, schema)
    return df.repartitionByRange(max(1, len(rows)), "part")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, ws: Workspace | None = None) -> int:
    """Encode every whole text, with ``end_id`` behind it, into ``folder``; returns the number of ids.

    ``docs``: doc_id long, text string; further columns are ignored. Null texts are empty: the end
    id alone. Rows are in ascending doc_id order, null ids first (in the files, they are the least 64-bit number;
    ``read_tokens`` gives null for it), rows of equal id in the order of a hash of their text. The folder
    must be one that all executors share. Each part is encoded once; its place in the corpus is the
    sum of the parts before it, one number for each part. An empty table gives no parts.
    """
    spark = docs.sparkSession
    ws = ws or Workspace(spark, "token-files")
    least = F.lit(-(2**63)).cast("long")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), least).alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the hash lets the range cut between rows of one id
    ordered = (
        rows.withColumn("h", F.xxhash64("text"))
        .repartitionByRange(parts_of(docs), "doc_id", "h")
        .sortWithinPartitions("doc_id", "h")
        .select("doc_id", "text")
    )
    written = ws.save(ordered.mapInArrow(_write(folder, tokenizer, end_id), "part string, docs long, tokens long, bytes_each long"), "parts")
    parts = sorted(written.collect())
    bases = np.concatenate([[0], np.cumsum([p.tokens for p in parts])]).astype(int).tolist()
    if parts:
        done = _parts(spark, [(p.part, b) for p, b in zip(parts, bases, strict=False)], "part string, base long").mapInArrow(_offsets(folder), "part string, docs long")
        if {tuple(r) for r in done.collect()} != {(p.part, p.docs) for p in parts}:
            raise RuntimeError(f"{folder}: offsets do not agree with the parts written")
    at, path = _place(folder)
    at.create_dir(path, recursive=True)
    form = {"dtype": f"<u{parts[0].bytes_each if parts else 2}", "end_id": end_id, "tokens": bases[-1], "parts": [[p.part, p.docs, p.tokens] for p in parts]}
    _publish(f"{folder}/format.json", iter([json.dumps(form).encode()]))
    return bases[-1]


def _read(folder: str, dtype: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("part").to_pylist():
                data, off, ids = open_ints(f"{folder}/{part}.bin", dtype), open_ints(f"{folder}/{part}.off", "<i8"), open_ints(f"{folder}/{part}.ids", "<i8")
                for s in range(0, len(ids), 1000):
                    e = min(len(ids), s + 1000)
                    wide = data[off[s] - off[0] : off[e] - off[0]].astype("<u4")
                    cut = (off[s : e + 1] - off[s]).tolist()
                    crc = [zlib.crc32(wide[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    doc_ids = np.asarray(ids[s:e])
                    arrays = [pa.array(doc_ids, mask=doc_ids == -(2**63)), pa.array(np.asarray(off[s:e])), pa.array(np.diff(off[s : e + 1])), pa.array(crc, pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        arrays.append(pa.array([wide[a:b].astype(np.int64) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """The documents of a token folder, one task a part: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    at, path = _place(folder)
    with at.open_input_file(f"{path}/format.json") as f:
        form = json.loads(f.read())
    parts = _parts(spark, [(p[0],) for p in form["parts"]], "part string")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return parts.mapInArrow(_read(folder, form["dtype"], with_ids), schema)
