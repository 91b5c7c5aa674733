"""Near-duplicate embeddings by sorted projection passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_pairs, each_group
from .common import Workspace, parts_of, pieces
from .components import connected_components, spanning

#: Passes, at least; and the share of lone pairs at the threshold that all passes together may miss, by estimate.
PASSES = 20
MISSED = 1e-6
WINDOW = 64
CHUNK = 1024


def _vectors(column: pa.Array) -> tuple[list, np.ndarray]:
    """Per row its float64 vector, or None where null, of no length, zero, or with bad components."""
    out, ok = [], np.zeros(len(column), bool)
    for i, v in enumerate(column):
        x = None
        if v.is_valid and v.values.null_count == 0 and len(v.values):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(x).all() or not np.abs(x).max() > 0:
                x = None
        ok[i] = x is not None
        out.append(x)
    return out, ok


def unit(x: np.ndarray) -> np.ndarray:
    """Scaled to length one in double precision; by the largest component first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=-1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, None, 2000):
        kind = b.schema.field("embedding").type.value_type
        vectors, ok = _vectors(b.column("embedding"))
        label = b.column("label")
        good = ok & label.is_valid().to_numpy(zero_copy_only=False)
        digest = [xxhash.xxh3_128_digest(v.tobytes()) if g else None for v, g in zip(vectors, good, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column("vec_id"), label, pa.array(digest, pa.binary()), pa.array([v if g else None for v, g in zip(vectors, good, strict=True)], pa.list_(kind))],
            names=["vec_id", "label", "digest", "x"],
        )


def _keys(passes: int, seed: int):
    """Each vector once per pass, with its concatenated random one-bit hashes as a sortable integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in pieces(batches, None, 2000):
            if not b.num_rows:
                continue
            dims = np.array([len(v.values) for v in b.column("x")])
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                part = b.take(pa.array(rows))
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((int(d), passes * 63))
                x = unit(np.asarray(part.column("x").flatten()).reshape(-1, d))
                bits = (x @ planes[d] > 0).reshape(len(rows), passes, 63)
                key = bits.astype(np.int64) @ (1 << np.arange(62, -1, -1, dtype=np.int64))
                for t in range(passes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), t, np.int32)), part.column("label"), pa.array(key[:, t]), part.column("rep"), part.column("x")],
                        names=["pass", "label", "key", "rep", "x"],
                    )

    return run


def _linked(ids, group, vectors, window: int, cosine: float, split: int | None = None):
    """Star edges that span the verified pairs among ``window`` following rows of equal group.

    split: only pairs with one row before it and one from it on.
    """
    a, b = [], []
    n = len(ids)
    dims = np.array([len(v) for v in vectors])
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        x = unit(np.stack([vectors[k] for k in at]))
        for s in range(0, len(at), 256):
            e = min(len(at), s + 256 + window)
            near = x[s : s + 256] @ x[s:e].T >= cosine
            p, q = np.nonzero(near)
            p, q = at[p + s], at[q + s]
            keep = (q > p) & (q - p <= window) & (group[p] == group[q])
            if split is not None:
                keep &= (p < split) & (q >= split)
            a.append(p[keep])
            b.append(q[keep])
    i, j = (np.concatenate(v) if v else np.zeros(0, int) for v in (a, b))
    root = spanning(n, i, j)
    moved = np.flatnonzero(root != np.arange(n))
    return ids[moved], ids[root[moved]]


_FOUND = "a long, b long, at int, side int, pos int, pass int, label int, rep long"


def _found(kind, a=None, b=None, at=None, side=None, pos=None, pas=None, label=None, rep=None, x=None) -> pa.RecordBatch:
    n = len(a) if a is not None else len(rep)
    col = lambda v, t: pa.nulls(n, t) if v is None else pa.array(v, t)
    i32, i64 = pa.int32(), pa.int64()
    return pa.RecordBatch.from_arrays(
        [col(a, i64), col(b, i64), col(at, i32), col(side, i32), col(pos, i32), col(pas, i32), col(label, i32), col(rep, i64), col(x, pa.list_(kind))],
        names=["a", "b", "at", "side", "pos", "pass", "label", "rep", "x"],
    )


def _slide(window: int, cosine: float):
    """Pairs inside a sorted partition, chunk by chunk, and its first and last ``window`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        held = None  # passes, labels, ids, vectors not yet compared with all that follow
        head_left, tail = window, None

        def ends(rows, side, kind):
            k = len(rows[2])
            return _found(kind, at=[at] * k, side=[side] * k, pos=np.arange(k), pas=rows[0], label=rows[1], rep=rows[2], x=list(rows[3]))

        def compare(rows, kind):
            group = rows[0].astype(np.int64) << 32 | (rows[1].astype(np.int64) & 0xFFFFFFFF)
            a, b = _linked(rows[2], group, rows[3], window, cosine)
            return _found(kind, a=a, b=b) if len(a) else None

        join = lambda r, s: s if r is None else tuple(np.concatenate(v) for v in zip(r[:3], s[:3], strict=True)) + (r[3] + s[3],)
        cut = lambda r, i, j: tuple(v[i:j] for v in r)
        head = kind = None
        for b in batches:
            if not b.num_rows:
                continue
            kind = b.schema.field("x").type.value_type
            new = (
                b.column("pass").to_numpy(), b.column("label").to_numpy(), b.column("rep").to_numpy(),
                [v.values.to_numpy() for v in b.column("x")],
            )
            if head_left:
                part = cut(new, 0, head_left)
                head, head_left = join(head, part), head_left - len(part[2])
            tail = join(tail, new)
            tail = cut(tail, max(0, len(tail[2]) - window), len(tail[2]))
            held = join(held, new)
            while len(held[2]) >= CHUNK + window:
                if (out := compare(cut(held, 0, CHUNK + window), kind)) is not None:
                    yield out
                held = cut(held, CHUNK, len(held[2]))
        if held is not None:
            if (out := compare(held, kind)) is not None:
                yield out
            yield ends(head, 1, kind)
            yield ends(tail, 0, kind)

    return run


def passes_for(most: int, cosine: float, window: int = WINDOW) -> int:
    """Passes that find a lone pair at the threshold among ``most`` vectors of a label but with a probability of ``MISSED``.

    A sign differs with probability angle / pi; the pair meets if its first signs agree until about a window of vectors shares them.
    """
    same = 1 - np.arccos(min(1.0, cosine)) / np.pi
    found = same ** (max(0.0, np.log2(max(most, 1) / window)) + 1)
    return max(PASSES, int(np.ceil(np.log(MISSED) / np.log1p(-min(found, 1 - 1e-9)))))


def seams_of(held: dict[int, int], window: int) -> list[tuple[int, int, int]]:
    """(partition, side, seam): whose last (0) and first (1) rows lie within a window before and behind each seam.

    held: by partition with rows, in order, how many of them, counted up to ``window``. A seam has the number of the
    partition before it; small partitions are close to several seams.
    """
    at = sorted(held)
    out = []
    for k in range(len(at) - 1):
        for side, near in ((0, at[k::-1]), (1, at[k + 1 :])):
            rows = 0
            for p in near:
                out.append((p, side, at[k]))
                rows += held[p]
                if rows >= window:
                    break
    return out


def _seams(window: int, cosine: float):
    """Pairs across a seam of partitions: the ``window`` rows before it with those behind it."""

    def compare(t: pa.Table) -> pa.RecordBatch | None:
        before = int((t.column("side").to_numpy() == 0).sum())
        t = t.slice(max(0, before - window), min(before, window) + window)
        side = t.column("side").to_numpy()
        group = t.column("pass").to_numpy().astype(np.int64) << 32 | (t.column("label").to_numpy().astype(np.int64) & 0xFFFFFFFF)
        vectors = [v.values.to_numpy() for c in t.column("x").chunks for v in c]
        a, b = _linked(t.column("rep").to_numpy(), group, vectors, window, cosine, split=int((side == 0).sum()))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"]) if len(a) else None

    return lambda batches: each_group(batches, ["seam"], compare)


def _count(cosine: float):
    """Per row of a block pair, the number of vectors it links with there."""

    def compare(t: pa.Table) -> pa.RecordBatch | None:
        bi, bj = t.column("bi")[0].as_py(), t.column("bj")[0].as_py()
        blk, rep = t.column("blk").to_numpy(), t.column("rep").to_numpy()
        copies = t.column("copies").to_numpy().astype(np.int64)
        vectors = [v.values.to_numpy() for c in t.column("x").chunks for v in c]
        links = np.zeros(len(rep), np.int64)
        dims = np.array([len(v) for v in vectors])
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            x = unit(np.stack([vectors[k] for k in at]))
            for s in range(0, len(at), 1024):
                rows = np.arange(s, min(len(at), s + 1024))
                near = x[rows] @ x.T >= cosine
                if bi == bj:
                    near[np.arange(len(rows)), rows] = False
                else:
                    near &= blk[at[rows]][:, None] != blk[at][None, :]
                links[at[rows]] = near @ copies[at]
        return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links)], names=["rep", "links"])

    return lambda batches: each_group(batches, ["component", "bi", "bj"], compare)


def dedup_embeddings(
    vectors: DataFrame, cosine: float = 0.98, passes: int | None = None, window: int = WINDOW, seed: int = 20, partitions: int | None = None, ws: Workspace | None = None
) -> DataFrame:
    """Link vectors of equal label whose cosine is at least ``cosine``.

    ``vectors``: vec_id long, embedding array of floats or doubles, label int; further columns are
    ignored. Returns one row per input row: vec_id, n_links, component_id, kept.

    Equal vectors of a label become one class, compared once. In each pass the classes are ordered
    by label and then lexicographically by the concatenated signs of random projections, and each
    is compared, in double precision, with the ``window`` classes that follow it, over seams of
    partitions too, however small these are. Unless given, the number of passes grows with the logarithm of the largest label (see
    ``passes_for``). Verified pairs of all passes are united into components. Links
    are then counted inside components, all against all in blocks, so that windows bound no count.

    Null labels, null, zero or empty vectors and vectors with null, NaN or infinite components link
    with nothing: no links, their own component, kept. Vectors of unequal lengths never link. A
    repeated row is another vector; different vectors under one vec_id are one node of the graph. An
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    ws = ws or Workspace(spark, "embedding-dedup")
    # single precision is moved as it is; comparing is in double precision
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    cols = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), F.col("embedding").cast(kind))
    seen = ws.save(cols.mapInArrow(_digests, f"vec_id long, label int, digest binary, x {kind}"), "seen")
    valid = seen.where("digest is not null")
    sizes = ws.save(valid.groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "sizes")
    members = ws.save(valid.select("vec_id", "label", "digest").join(sizes, ["label", "digest"]).select("vec_id", "rep", "copies"), "members")
    # one row of each class: a row may come twice
    reps = ws.save(
        valid.join(sizes.withColumnRenamed("rep", "vec_id"), ["vec_id", "label", "digest"])
        .select(F.col("vec_id").alias("rep"), "label", "digest", "copies", "x")
        .dropDuplicates(["rep", "label", "digest"])
        .drop("digest"),
        "reps",
    )
    if passes is None:
        largest = sizes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        passes = passes_for(largest, cosine, window)
    ordered = (
        reps.select("rep", "label", "x")
        .mapInArrow(_keys(passes, seed), f"pass int, label int, key long, rep long, x {kind}")
        .repartitionByRange(partitions or parts_of(reps, (64 << 20) // passes), "pass", "label", "key", "rep")
        .sortWithinPartitions("pass", "label", "key", "rep")
    )
    found = ws.save(ordered.mapInArrow(_slide(window, cosine), f"{_FOUND}, x {kind}"), "found")
    ends = found.where("at is not null")
    # how many rows partitions hold, up to a window: as many numbers as partitions
    held = {r["at"]: r["count"] for r in ends.where("side = 0").groupBy("at").count().collect()}
    edges = found.where("a is not null").select("a", "b")
    if len(held) > 1:
        near = spark.createDataFrame(seams_of(held, window), "at int, side int, seam int")
        seams = (
            ends.join(near, ["at", "side"])
            .drop("a", "b")
            .repartition("seam")
            .sortWithinPartitions("seam", "side", "at", "pos")
            .drop("at")
        )
        edges = edges.unionByName(seams.mapInArrow(_seams(window, cosine), "a long, b long"))
    parts = ws.save(connected_components(edges, ws), "parts")
    sized = ws.save(parts.groupBy("component").agg(F.count("*").alias("size")), "sized")
    inside = reps.join(parts.withColumnRenamed("id", "rep"), "rep").join(sized, "component")
    links = (
        block_pairs(inside.select("rep", "component", "size", "copies", "x"), "component", "rep", "size")
        .mapInArrow(_count(cosine), "rep long, links long")
        .groupBy("rep")
        .agg(F.sum("links").alias("links"))
    )
    known = ws.save(parts.withColumnRenamed("id", "rep").join(links, "rep", "left"), "known")
    linked = members.join(known, "rep", "left").select(
        "vec_id",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    alone = seen.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.expr("coalesce(vec_id = component_id, true)"))
