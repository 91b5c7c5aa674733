"""Near-duplicate documents by min-max hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_pairs, each_group
from .common import WordHashes, Workspace, mix64, pieces, small_batches
from .components import connected_components, spanning

SHINGLE = 5
PERCENT = 85
#: Probability with which a pair at the threshold shares no band, at most.
MISS = 3e-7
#: Permutations in a band; each gives two signature values, its minimum and its maximum.
BAND_PERMUTATIONS = 3
#: Standard deviations of the estimated similarity that a pair in one bucket may lie below the
#: threshold and still be confirmed.
DEVIATIONS = 5
#: Shingles hashed at once.
BLOCK = 1 << 16

_ODD = np.random.default_rng(0x5EED).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands_for(percent: int, per_band: int = BAND_PERMUTATIONS) -> int:
    """Bands of which a pair at ``percent`` shares none with a probability of ``MISS`` at most: 32 at 85, 50 at 80."""
    same = (percent / 100) ** (2 * per_band)
    return 1 if same >= 1 else math.ceil(math.log(MISS) / math.log1p(-same))


def plausible_for(percent: int, values: int) -> float:
    """The estimate from so many signature values, rounded down, under which a pair need not be confirmed: 0.72 at 85."""
    p = percent / 100
    return math.floor(100 * (p - DEVIATIONS * math.sqrt(p * (1 - p) / values))) / 100


def shingle_hashes(text: bytes | None, words: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text.

    Words are maximal runs of bytes other than ASCII white space, A-Z lower-cased. A text of one
    to k - 1 words is one shingle; a text without words, or null, has none.
    """
    tokens = text.lower().split() if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(len(h), k), np.uint64)
    for j in range(min(k, len(h))):
        out += h[j : j + n] * _ODD[j]
    return np.unique(mix64(out))


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(0xD0C5)
    draw = lambda: rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
    return draw() + np.uint64(1), draw()


def minmax(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signatures: row per set, under each permutation its minimum and then its maximum (32 bits)."""
    out = np.zeros((len(sets), 2 * len(a)), np.uint32)
    start = 0
    while start < len(sets):
        end, total = start, 0
        while end < len(sets) and (end == start or total + len(sets[end]) <= BLOCK):
            total += len(sets[end])
            end += 1
        x = np.concatenate(sets[start:end])
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets[start : end - 1]])]).astype(np.int64)
        for k in range(len(a)):
            y = (x * a[k] + b[k]) >> np.uint64(32)
            out[start:end, 2 * k] = np.minimum.reduceat(y, at)
            out[start:end, 2 * k + 1] = np.maximum.reduceat(y, at)
        start = end
    return out


def _signatures(bands: int, per_band: int):
    a, b = permutations(bands * per_band)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in pieces(batches):
            if not batch.num_rows:
                continue
            sets = [shingle_hashes(t.as_py(), words) for t in batch.column("text")]
            full = [i for i, s in enumerate(sets) if len(s)]
            digest: list = [None] * len(sets)
            keys: list = [None] * len(sets)
            sketch: list = [None] * len(sets)
            if full:
                sig = minmax([sets[i] for i in full], a, b)
                band = np.full((len(full), bands), 1, np.uint64) * np.arange(1, bands + 1, dtype=np.uint64)
                shaped = sig.reshape(len(full), bands, 2 * per_band).astype(np.uint64)
                for j in range(2 * per_band):
                    band = mix64(band + shaped[:, :, j] * _ODD[j])
                low = (sig & np.uint32(0xFF)).astype(np.uint8)
                for r, i in enumerate(full):
                    digest[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                    keys[i] = band[r].view(np.int64)
                    sketch[i] = low[r].tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "digest", "keys", "sketch"],
            )

    return run


def _confirm(percent: int):
    """Pairs whose full shingle sets are similar enough; their texts come side by side."""
    words = WordHashes()
    recent: dict[int, np.ndarray] = {}

    def of(i: int, text: pa.Scalar) -> np.ndarray:
        if i not in recent:
            if len(recent) >= 32:
                del recent[next(iter(recent))]
            recent[i] = shingle_hashes(text.as_py(), words)
        return recent[i]

    def compare(t: pa.Table) -> pa.RecordBatch | None:
        a, b = t.column("a")[0].as_py(), t.column("b")[0].as_py()
        side, text = t.column("side").to_pylist(), t.column("text")
        one = [k for k, s in enumerate(side) if not s][:1]
        two = [k for k, s in enumerate(side) if s][:1]
        if not one or not two:
            return None
        x, y = of(a, text[one[0]]), of(b, text[two[0]])
        both = len(np.intersect1d(x, y, assume_unique=True))
        if 100 * both < percent * (len(x) + len(y) - both):
            return None
        return pa.RecordBatch.from_arrays([pa.array([a]), pa.array([b])], names=["a", "b"])

    return lambda batches: each_group(batches, ["a", "b"], compare)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, checked on the whole texts.

    The ends of the pairs are joined to the texts (hashing the narrow ends, not sorting the
    texts), and both ends of a pair then meet; nothing else of a group comes together.
    """
    ends = pairs.select("a", "b", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("doc_id")), F.struct(F.lit(1).alias("side"), F.col("b").alias("doc_id")))).alias("e"))
    return (
        texts.join(ends.select("a", "b", "e.side", "e.doc_id").hint("shuffle_hash"), "doc_id")
        .select("a", "b", "side", "text")
        .repartition("a", "b")
        .sortWithinPartitions("a", "b", "side")
        .mapInArrow(_confirm(percent), "a long, b long")
    )


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the one and of the other block of a block pair; the same rows inside a block."""
    bi, bj, blk = t.column("bi")[0].as_py(), t.column("bj")[0].as_py(), t.column("blk").to_numpy()
    return np.flatnonzero(blk == bi), np.flatnonzero(blk == bj)


def _candidates(t: pa.Table, percent: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block pair, of different components, that sizes and sketches allow."""
    comp, n = t.column("component").to_numpy(), t.column("n_shingles").to_numpy()
    sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(n), -1)
    first, second = _sides(t)
    a, b = [np.zeros(0, int)], [np.zeros(0, int)]
    for i in first:
        j = second[(comp[second] != comp[i]) & (100 * np.minimum(n[second], n[i]) >= percent * np.maximum(n[second], n[i]))]
        if len(j):
            j = j[((sk[j] == sk[i]).mean(axis=1) - 1 / 256) / (1 - 1 / 256) >= least]
            a.append(np.full(len(j), i))
            b.append(j)
    a, b = np.concatenate(a), np.concatenate(b)
    once = a < b if t.column("bi")[0] == t.column("bj")[0] else slice(None)
    return a[once], b[once]


def _star(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch | None:
    """Edges that span what the pairs (a, b) connect: no more than there are rows."""
    names, at = np.unique(ids, return_inverse=True)
    root = spanning(len(names), at[a], at[b])
    moved = np.flatnonzero(root != np.arange(len(names)))
    return pa.RecordBatch.from_arrays([pa.array(names[root[moved]]), pa.array(names[moved])], names=["a", "b"]) if len(moved) else None


def _plausible(percent: int, least: float):
    """Which components of a bucket may belong together, as spanning edges."""

    def compare(t: pa.Table) -> pa.RecordBatch | None:
        return _star(t.column("component").to_numpy(), *_candidates(t, percent, least))

    return lambda batches: each_group(batches, ["key", "bi", "bj"], compare)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for b in pieces(batches):
        made = [shingle_hashes(t.as_py(), words).tobytes() for t in b.column("text")]
        keep = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(made, pa.binary())], names=[*keep, "shingles"])


def _confirm_blocks(percent: int, least: float):
    """Links between components of a cluster, checked on full sets, as spanning edges."""

    def compare(t: pa.Table) -> pa.RecordBatch | None:
        a, b = _candidates(t, percent, least)
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        ok = np.zeros(len(a), bool)
        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            ok[k] = 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)
        return _star(t.column("component").to_numpy(), a[ok], b[ok])

    return lambda batches: each_group(batches, ["cluster", "bi", "bj"], compare)


def dedup_documents(
    docs: DataFrame,
    percent: int = PERCENT,
    bands: int | None = None,
    per_band: int = BAND_PERMUTATIONS,
    plausible: float | None = None,
    ws: Workspace | None = None,
) -> DataFrame:
    """Link documents whose sets of 5-word shingles have a Jaccard similarity of ``percent`` or more.

    ``docs``: doc_id long, text string; further columns are ignored. Returns one row per input
    row: doc_id, n_shingles, component_id, kept.

    Under each permutation a document keeps the minimum and the maximum of its shingles' hashes,
    so at 85 percent 96 hash evaluations give 192 signature values, banded six by six. Unless given, the
    number of bands follows from ``percent``, so that a pair at the threshold shares no band with a
    probability of 3e-7 at most, and so does the estimate below which pairs are not confirmed. Documents of equal sets become one class. In each bucket
    every class is checked against the least one on full sets; then, where a bucket still spans
    several components that sizes and sketches allow to belong together, the members of these
    components meet in blocks, all pairs across components, on full sets: no bucket is capped, no
    link that only other members show is lost, and no list of pairs is made.

    Documents without words, or null, have 0 shingles, link with nothing and are kept. Repeated rows are
    copies and get equal results; rows of one doc_id with different texts are one node,
    of which one text is compared. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ws = ws or Workspace(spark, "minhash-dedup")
    bands = bands_for(percent, per_band) if bands is None else bands
    plausible = plausible_for(percent, 2 * bands * per_band) if plausible is None else plausible
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    signed = ws.save(
        texts.mapInArrow(_signatures(bands, per_band), "doc_id long, n_shingles long, digest binary, keys array<long>, sketch binary"), "signed"
    )
    classes = ws.save(signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    members = ws.save(
        signed.where("digest is not null").select("doc_id", "n_shingles", "digest").join(classes, "digest").select("doc_id", "n_shingles", "rep"),
        "members",
    )
    reps = ws.save(
        signed.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "digest"])
        .dropDuplicates(["doc_id", "digest"])
        .select(F.col("doc_id").alias("rep"), "n_shingles", "keys", "sketch"),
        "reps",
    )
    rows = reps.select("rep", "n_shingles", F.explode("keys").alias("key"))
    buckets = ws.save(
        rows.groupBy("key").agg(F.min(F.struct("rep", "n_shingles")).alias("p"), F.count("*").alias("size")).where("size > 1"), "buckets"
    )
    shared = ws.save(rows.join(buckets, "key"), "shared")
    apart = f"100 * least(n_shingles, p.n_shingles) >= {int(percent)} * greatest(n_shingles, p.n_shingles)"
    stars = ws.save(
        shared.where("rep <> p.rep").where(apart).select(F.col("p.rep").alias("a"), F.col("rep").alias("b")).distinct(), "stars"
    )
    links = ws.save(confirmed(stars, texts, percent), "links")
    parts = ws.save(connected_components(links, ws, "first").withColumnRenamed("id", "rep"), "parts")

    placed = shared.select("key", "rep").join(parts, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = ws.save(placed, "placed")
    open_ = ws.save(
        placed.groupBy("key")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"))
        .where("lo <> hi")
        .select("key", "size"),
        "open",
    )
    rest = placed.join(open_, "key").join(reps.select("rep", "n_shingles", "sketch"), "rep")
    maybe = (
        block_pairs(rest, "key", "rep", "size", least=256)  # small rows, and a document is in many buckets
        .select("key", "bi", "bj", "blk", "rep", "component", "n_shingles", "sketch")
        .mapInArrow(_plausible(percent, plausible), "a long, b long")
    )
    maybe = ws.save(maybe, "maybe_edges")
    final = parts
    if not maybe.isEmpty():
        # clusters of components that may belong together; their members meet in blocks, each pair once
        clusters = ws.save(connected_components(maybe, ws, "maybe"), "clusters").select(F.col("id").alias("component"), F.col("component").alias("cluster"))
        known = reps.select("rep", "n_shingles", "sketch").join(parts, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        inside = ws.save(known.join(clusters, "component"), "inside")
        sizes = inside.groupBy("cluster").agg(F.count("*").alias("size"))
        with_sets = ws.save(
            texts.join(inside.withColumnRenamed("rep", "doc_id").hint("shuffle_hash"), "doc_id")
            .select("cluster", "doc_id", "component", "n_shingles", "sketch", "text")
            .mapInArrow(_sets, "cluster long, doc_id long, component long, n_shingles long, sketch binary, shingles binary"),
            "with_sets",
        )
        links2 = (
            block_pairs(with_sets.join(ws.save(sizes, "sizes"), "cluster"), "cluster", "doc_id", "size")
            .select("cluster", "bi", "bj", "blk", "component", "n_shingles", "sketch", "shingles")
            .mapInArrow(_confirm_blocks(percent, plausible), "a long, b long")
        )
        # links between components: the least document of a component stands for it
        joined = ws.save(connected_components(links2, ws, "last"), "joined").select(F.col("id").alias("component"), F.col("component").alias("over"))
        own = inside.select("rep", "component").distinct().join(joined, "component").select("rep", F.col("over").alias("component"))
        final = ws.save(parts.join(own.select("rep"), "rep", "left_anti").unionByName(own), "final")
    linked = members.join(final, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = signed.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.expr("coalesce(doc_id = component_id, true)"))
