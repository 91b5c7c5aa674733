"""Codes of vectors by parts: Lloyd rounds in exact integers, rescans avoided by norm-of-sum bounds.

Every part of a vector keeps its entry, an upper bound of the distance to it and a lower bound of the distance to all others,
each with the round it was worked out in. The driver keeps the codebooks of all rounds (bounded by parameters), so a bound of an earlier round
is carried on by the true net displacement of the entry since then, which is at most the sum of its moves. Only parts whose
bounds cross are compared with all entries again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, pieces

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integer components from here on leave their vector without a code: squared distances would pass 64 bits.
LIMIT = 1 << 26
#: Relative slack of a bound in double precision.
SLACK = 1e-9
#: Labels up to which their totals are broadcast; more are joined.
BROADCAST_LABELS = 100_000

STATE = np.dtype([("code", "u1", PARTS), ("was", "u1", PARTS), ("upper", "f8", PARTS), ("lower", "f8", PARTS), ("upper_at", "u1", PARTS), ("lower_at", "u1", PARTS)])
Codebook = np.ndarray  # part x entry x component


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries."""
    return ((x[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)


def assign(x: np.ndarray, state: np.ndarray, history: list[Codebook]) -> int:
    """Bring the state of rows (n x part x component) to the last codebook; returns how many parts were compared with all entries."""
    now = len(history) - 1
    entries = history[now]
    state["was"] = state["code"]
    rescanned = 0
    for p in range(x.shape[1]):
        s = {k: state[k][:, p] for k in STATE.names}
        if now == 0:
            doubt = np.arange(len(x))
        else:
            # net displacement of each entry since each round
            moved = np.sqrt(((entries[p][None] - np.stack([h[p] for h in history])).astype(float) ** 2).sum(axis=2))
            others = np.where(np.eye(moved.shape[1], dtype=bool)[None], -1.0, moved[:, None, :]).max(axis=2).clip(0)
            lower = s["lower"] - others[s["lower_at"], s["code"]]
            upper = s["upper"] + moved[s["upper_at"], s["code"]]
            doubt = np.flatnonzero(upper * (1 + SLACK) >= lower * (1 - SLACK))
            # the exact distance to the own entry first
            own = np.sqrt(((x[doubt, p] - entries[p][s["code"][doubt]]) ** 2).sum(axis=1).astype(float))
            s["upper"][doubt], s["upper_at"][doubt] = own, now
            doubt = doubt[own * (1 + SLACK) >= lower[doubt] * (1 - SLACK)]
        rescanned += len(doubt)
        for at in range(0, len(doubt), 8192):
            rows = doubt[at : at + 8192]
            d = distances(x[rows, p], entries[p])
            best = d.argmin(axis=1)  # of equal ones the lower index
            s["code"][rows] = best
            s["upper"][rows] = np.sqrt(d[np.arange(len(rows)), best].astype(float))
            d[np.arange(len(rows)), best] = np.iinfo(np.int64).max
            s["lower"][rows] = np.sqrt(d.min(axis=1).astype(float)) if d.shape[1] > 1 else np.inf
            s["upper_at"][rows] = s["lower_at"][rows] = now
    return rescanned


def _rows_of(batch: pa.RecordBatch) -> np.ndarray:
    v = batch.column("v")
    return np.asarray(v.flatten()).astype(np.int64).reshape(batch.num_rows, PARTS, -1)


def _state_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("state").to_pylist()), STATE).copy()


def _assigning(history: list[Codebook]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, None, rows=20_000):
            if not b.num_rows:
                continue
            state = np.zeros(b.num_rows, STATE) if len(history) == 1 else _state_of(b)
            assign(_rows_of(b), state, history)
            packed = pa.array([x.tobytes() for x in state], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("v"), packed], names=["vec_id", "label", "v", "state"])

    return run


def _moved(first: bool, entries: int):
    """What parts that changed their entry add to the sums and counts of entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in pieces(batches, None, rows=20_000):
            if not b.num_rows:
                continue
            x, state = _rows_of(b), _state_of(b)
            if total is None:
                total = np.zeros((PARTS, entries, x.shape[2] + 1), np.int64)
            for p in range(PARTS):
                rows = np.arange(len(x)) if first else np.flatnonzero(state["code"][:, p] != state["was"][:, p])
                ones = np.concatenate([x[rows, p], np.ones((len(rows), 1), np.int64)], axis=1)
                np.add.at(total[p], state["code"][rows, p], ones)
                if not first:
                    np.subtract.at(total[p], state["was"][rows, p], ones)
        if total is not None:
            p, e, k = (a.astype(np.int32) for a in np.nonzero(total))
            yield pa.RecordBatch.from_pydict({"part": p, "entry": e, "place": k, "value": total[p, e, k]})

    return run


def _coded(history: list[Codebook]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, None, rows=20_000):
            if not b.num_rows:
                continue
            x, state = _rows_of(b), np.zeros(b.num_rows, STATE) if len(history) == 1 else _state_of(b)
            assign(x, state, history)
            near = np.stack([history[-1][p][state["code"][:, p]] for p in range(PARTS)], axis=1)
            error = ((x - near) ** 2).sum(axis=(1, 2))
            code = pa.array([c.tobytes().hex() for c in state["code"]], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), code, pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def _integers(vector: Column) -> Column:
    """floor(4096 * x) of each component; null where one is out of bounds."""
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    inside = F.forall(vector, lambda x: F.abs(x.cast("double")) * SCALE < LIMIT)
    return F.when(inside, F.transform(scaled, lambda x: x.cast("int")))


def code_vectors(embeddings: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable row of ``embeddings(vec_id, embedding, label)``.

    Rows whose vector is null or holds null or non-finite components are dropped. Vectors whose length is not that of
    the codebooks (the first usable one's by vec_id whose length is a multiple of 8), or with components of 16,384 or more, stay with null code and error.
    Rows repeated, or without vec_id, count as rows of their own; null ids come last when the first codebook is chosen, equal ids by their vectors. With fewer
    than ``entries`` vectors there are as many entries; an empty table gives no rows. A total that passes 64 bits is null.
    """
    spark = embeddings.sparkSession
    ws = Workspace(spark, "part-codes")
    usable = F.col("embedding").isNotNull() & F.coalesce(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False)
    )
    kept = embeddings.where(usable).select("vec_id", "label", _integers(F.col("embedding")).alias("v"))
    fitting = kept.where((F.size("v") > 0) & (F.size("v") % PARTS == 0))
    by_id = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    one = fitting.orderBy(*by_id).select(F.size("v")).first()
    width = one[0] if one else PARTS
    rows = fitting.where(F.size("v") == width)
    first = np.array([r.v for r in rows.orderBy(*by_id).select("v").limit(entries).collect()], np.int64).reshape(-1, PARTS, width // PARTS)
    history = [first.transpose(1, 0, 2)]
    n = len(first)
    totals: dict[tuple[int, int, int], int] = {}
    now = rows
    for r in range(rounds if n else 0):
        now = ws.save(now.mapInArrow(_assigning(history), _schema(embeddings, "v array<int>, state binary")), f"round{r}")
        sums = now.mapInArrow(_moved(r == 0, n), "part int, entry int, place int, value long")
        for x in sums.groupBy("part", "entry", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
            key = (x.part, x.entry, x.place)
            totals[key] = totals.get(key, 0) + int(x.value)
        history.append(_entries(history[-1], totals))
        if r:
            ws.drop(f"round{r - 1}")
    digest = hashlib.sha256(",".join(str(v) for v in history[-1].reshape(-1).tolist()).encode()).hexdigest()
    schema = _schema(embeddings, "code string, error long")
    coded = now.mapInArrow(_coded(history), schema) if n else spark.createDataFrame([], schema)
    others = kept.where(F.coalesce(F.size("v") != width, F.lit(True))).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = ws.save(coded.unionByName(others), "coded")
    if rounds and n:
        ws.drop(f"round{rounds - 1}")
    by_label = ws.save(coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total")), "labels")
    if by_label.count() <= BROADCAST_LABELS:
        by_label = F.broadcast(by_label)
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", F.expr("try_cast(total AS BIGINT)").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))


def _schema(embeddings: DataFrame, more: str) -> str:
    kinds = dict(embeddings.dtypes)
    return f"vec_id {kinds['vec_id']}, label {kinds['label']}, {more}"


def _entries(before: Codebook, totals: dict[tuple[int, int, int], int]) -> Codebook:
    """The floor of the mean of each entry's parts; an entry without any stays."""
    after = before.copy()
    parts, n, width = before.shape
    for p in range(parts):
        for e in range(n):
            if count := totals.get((p, e, width), 0):
                after[p, e] = [totals.get((p, e, k), 0) // count for k in range(width)]
    return after
