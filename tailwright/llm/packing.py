"""Packing documents into fixed windows by non-negative least squares over length combinations."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, pieces, small_batches
from .tokens import SLICE, encoder

WINDOW = 2048
END_ID = 1


def combinations(present: np.ndarray, window: int) -> np.ndarray:
    """All (a, b, c), a >= b >= c, of present lengths (c may be 0) that fill the window exactly."""
    have = np.zeros(window + 1, bool)
    have[present[(present > 0) & (present < window)]] = True
    lengths = np.flatnonzero(have)
    out = []
    have[0] = True
    for a in lengths[::-1]:
        b = lengths[(lengths <= a) & (lengths >= (window - a + 1) // 2) & (lengths <= window - a)]
        c = window - a - b
        ok = have[c] & (c <= b)
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), int)


def nnls(combos: np.ndarray, hist: np.ndarray, sweeps: int = 4) -> np.ndarray:
    """Repeat counts x >= 0 that minimize |A x - hist|^2, by coordinate-wise descent.

    Column s of A counts the lengths in combination s. One coordinate is solved at a time against
    the current residual, which keeps most counts at zero.
    """
    rest = hist.astype(float).tolist()
    rest[0] = 0.0
    rows = combos.tolist()
    x = [0.0] * len(rows)
    for _ in range(sweeps):
        moved = 0.0
        for s, (a, b, c) in enumerate(rows):
            if a == b:
                grad, norm = (2 * rest[a] + rest[c], 5) if c and c != a else ((3 * rest[a], 9) if c else (2 * rest[a], 4))
            elif b == c:
                grad, norm = rest[a] + 2 * rest[b], 5
            elif c:
                grad, norm = rest[a] + rest[b] + rest[c], 3
            else:
                grad, norm = rest[a] + rest[b], 2
            step = max(-x[s], grad / norm)
            if step > 1e-9 or step < -1e-9:
                x[s] += step
                rest[a] -= step
                rest[b] -= step
                if c:
                    rest[c] -= step
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return np.array(x)


def plan(hist: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths side by side, how often) that use every length of the histogram exactly.

    Rounded counts of the least-squares solution come first, as far as lengths last; what remains
    is packed greedily, the longest with the largest that still fit.
    """
    left = hist.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[window]:
        out.append(((window,), int(left[window])))
        left[window] = 0
    combos = combinations(np.flatnonzero(left), window)
    counts = np.rint(nnls(combos, left)).astype(np.int64)
    for s in np.argsort(-counts, kind="stable"):
        if counts[s] <= 0:
            break
        lengths = tuple(int(v) for v in combos[s] if v)
        times = min(int(counts[s]), *(int(left[v]) // lengths.count(v) for v in lengths))
        if times > 0:
            out.append((lengths, times))
            for v in lengths:
                left[v] -= times
    while True:
        have = np.flatnonzero(left[:window])
        have = have[have > 0]
        if not len(have):
            return out
        chosen: dict[int, int] = {}
        room = window
        for v in have[::-1].tolist():
            k = min(room // v, int(left[v]))
            if k:
                chosen[v] = k
                room -= k * v
            if not room:
                break
        times = min(int(left[v]) // k for v, k in chosen.items())
        out.append((tuple(v for v, k in chosen.items() for _ in range(k)), times))
        for v, k in chosen.items():
            left[v] -= k * times


def slots(strategies: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Where the r-th piece of a length goes: runs of ranks, with their first sequence and their offset."""
    used: dict[int, int] = {}
    rows = []
    base = 0
    for lengths, times in strategies:
        offset = 0
        for v in lengths:
            first = used.get(v, 0)
            rows.append((v, first, base, offset, sum(lengths)))
            used[v] = first + times
            offset += v
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": table[:, 0] << 44 | table[:, 1], "first": table[:, 1], "base": table[:, 2], "offset": table[:, 3], "total": table[:, 4]}


def _pieces(tokenizer: str, end_id: int, window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, drops_space=True)
        for batch in pieces(batches, rows=10_000, size=SLICE):
            got, at = coder.encode_flat(batch.column("text"))
            ids = np.insert(got, at[1:], end_id).astype("<u4")
            total = np.diff(at) + 1
            times = -(-total // window)
            doc = np.repeat(np.arange(len(total)), times)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(times) - times, times)) * window
            length = np.minimum(window, total[doc] - start)
            place = ((np.cumsum(total) - total)[doc] + start).tolist()
            parts = [ids[p : p + n] for p, n in zip(place, length.tolist(), strict=True)]
            arrays = [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(total[doc])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                arrays.append(pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _assign(table: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            key = batch.column("length").to_numpy() << 44 | rank
            at = np.searchsorted(table["key"], key, side="right") - 1
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(table["base"][at] + rank - table["first"][at]), pa.array(table["offset"][at]), pa.array(table["total"][at])],
                names=[*keep, "sequence_id", "offset", "sequence_tokens"],
            )

    return run


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, ws: Workspace | None = None) -> DataFrame:
    """Pack every document's ids, with ``end_id`` behind them, into sequences of at most ``window`` ids.

    ``docs``: doc_id long, text string; further columns are ignored. Longer documents are cut every
    ``window`` ids; a whole window is a sequence by itself. The other pieces are dealt out by length:
    repeat counts of all combinations of up to three lengths that fill a window are solved for the
    histogram (at most ``window`` numbers, the only thing the driver sees), and the rest is packed
    greedily. A piece finds its sequence by its rank among the pieces of its length. Returns per
    piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens (the
    sequence's ids; what it lacks is padding), and ids if asked for.

    Null and empty texts are the end id alone. Repeated rows are packed like other documents; an
    empty table gives no rows. A length that a third of the rows share is ranked in salted parts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ws = ws or Workspace(spark, "packing")
    extra = ", ids array<long>" if with_ids else ""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    pieces = ws.save(
        rows.mapInArrow(_pieces(tokenizer, end_id, window, with_ids), f"doc_id long, start long, length long, ids_crc32 long, doc_tokens long{extra}"), "pieces"
    )
    hist = np.zeros(window + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        hist[r["length"]] = r["count"]
    salts = max(64, int(hist.sum()) // 1_000_000)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        salted.withColumn("r", F.row_number().over(within) - 1)
        .join(sizes, ["length", "salt"])
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else []), (F.col("base") + F.col("r")).alias("rank"))
    )
    schema = f"doc_id long, start long, length long, ids_crc32 long, doc_tokens long{extra}, sequence_id long, offset long, sequence_tokens long"
    return ranked.mapInArrow(_assign(slots(plan(hist, window))), schema)
