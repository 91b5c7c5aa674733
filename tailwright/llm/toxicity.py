"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in shards on the executors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, fold, give_back, small_batches
from .common import pieces as slices

#: Labelled texts of a shard, by number and by bytes; and shards whose numbers are added up in one go.
SHARD_ROWS, SHARD_BYTES = 4096, 16 << 20
GROUP_SHARDS = 16
#: Rounds over all labelled texts: so many that some ``LEARNED`` texts are learned from, within these bounds.
EPOCHS, LEAST_EPOCHS, LEARNED = 8, 3, 1 << 15
#: Labels that are sent to all executors; more are joined by a shuffle.
SENT_LABELS = 1 << 23
#: Steps of a score that thresholds tell apart, and languages with thresholds of their own.
BINS, LANGS = 1 << 16, 1000
BUCKETS = 1 << 16
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
#: A word is embedded as the sum over itself and its first 4, 5 and 6 letters.
PREFIXES = (4, 5, 6)
PIECES = 1 + len(PREFIXES)
WORDS_AT_ONCE = 150_000

_EDGE = re.compile(r"^\W+|\W+$")
_PAD = b""


class Begins(dict):
    """The first letters of a word -> their bucket, remembered for a bounded number of them."""

    def __missing__(self, start: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        out = self[start] = _bucket(f"{len(start)}:{start}")
        return out


_BEGINS = Begins()


def _bucket(s: str) -> int:
    return 1 + xxhash.xxh64_intdigest(s.encode("utf-8", "replace")) % (BUCKETS - 1)


def pieces(word: bytes) -> list[int]:
    """Buckets of a word and of its beginnings; bucket 0 is padding, and no piece."""
    w = word.decode("utf-8", "replace").lower()
    if not w.isalnum():
        w = _EDGE.sub("", w)
    if not w:
        return [0] * PIECES
    return [_bucket(w), *(_BEGINS[w[:n]] if len(w) >= n else 0 for n in PREFIXES)]


class Pieces(dict):
    """word -> its buckets, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> list[int]:
        if len(self) >= 300_000:
            self.clear()
        out = self[word] = pieces(word)
        return out


@dataclass
class Model:
    emb: np.ndarray  # BUCKETS x DIM
    conv: list[np.ndarray]  # per width: width x DIM x FILTERS
    bias: np.ndarray  # len(WIDTHS) * FILTERS
    out: np.ndarray
    out_bias: float
    thresholds: dict[str | None, float]

    def folded(self) -> np.ndarray:
        """Responses of every filter row to every bucket: the convolution becomes a sum of rows."""
        return np.concatenate([self.emb @ row for w in self.conv for row in w], axis=1).astype(np.float32)


def _responses(rows: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Per width, the filters' responses to the windows that begin at each position.

    Of a text's padding only the first place begins a window: others would reach into the next text.
    """
    ends = np.append(starts[1:], len(rows))
    beyond = (ends[:, None] - np.arange(1, max(WIDTHS))).ravel()
    out, c = [], 0
    for w in WIDTHS:
        y = rows[:, c : c + FILTERS].copy()
        for j in range(1, w):
            y[:-j] += rows[j:, c + j * FILTERS : c + (j + 1) * FILTERS]
        c += w * FILTERS
        y[beyond] = -np.inf
        out.append(y)
    return out


def _flat(texts: list[bytes | None], vocab: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts in a row, each text followed by padding, and where each begins."""
    ids: list[int] = []
    starts = []
    pad = [vocab.setdefault(_PAD, len(vocab))] * max(WIDTHS)
    for t in texts:
        starts.append(len(ids))
        ids += [vocab.setdefault(w, len(vocab)) for w in (t or b"").split()]
        ids += pad
    return np.array(ids, np.int64), np.array(starts, np.int64)


def logits(model: Model, folded: np.ndarray, texts: list[bytes | None], known: Pieces) -> np.ndarray:
    """One value per whole text; longer texts only have more windows under the maximum."""
    vocab: dict[bytes, int] = {}
    ids, starts = _flat(texts, vocab)
    table = np.array([known[w] if w else [0] * PIECES for w in vocab], np.int64)
    rows = np.zeros((len(vocab), folded.shape[1]), np.float32)
    for k in range(PIECES):
        rows += folded[table[:, k]]
    pooled = np.concatenate([np.maximum.reduceat(y, starts, axis=0) for y in _responses(rows[ids], starts)], axis=1)
    return np.maximum(pooled + model.bias, 0) @ model.out + model.out_bias


@dataclass
class State:
    """A model on its way: its numbers, the moments of Adam, the sums of squares of the embeddings, and how often rows of them were moved."""

    emb: np.ndarray  # BUCKETS x DIM
    squares: np.ndarray  # BUCKETS
    small: np.ndarray  # values, first and second moments of SMALL numbers
    step: float = 0.0

    @staticmethod
    def fresh(seed: int) -> State:
        rng = np.random.default_rng(seed)
        n = len(WIDTHS) * FILTERS
        emb = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
        emb[0] = 0
        small = np.zeros((3, SMALL))
        small[0] = np.concatenate([rng.normal(0, 0.35, SUM_WIDTHS * DIM * FILTERS), np.full(n, 0.05), rng.normal(0, 0.5, n), [0.0]])
        return State(emb, np.zeros(BUCKETS, np.float32), small)

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Views of filter rows (all widths' in a row), biases and output weights; the last number is the output's bias."""
        n, k = len(WIDTHS) * FILTERS, SUM_WIDTHS * DIM * FILTERS
        v = self.small[0]
        return v[:k].reshape(SUM_WIDTHS, DIM, FILTERS), v[k : k + n], v[k + n : k + 2 * n]

    def model(self) -> Model:
        rows, bias, out = self.parts()
        at = np.cumsum([0, *WIDTHS])
        return Model(self.emb.astype(float), [rows[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], bias, out, float(self.small[0, -1]), {})


SUM_WIDTHS = sum(WIDTHS)
SMALL = SUM_WIDTHS * DIM * FILTERS + 2 * len(WIDTHS) * FILTERS + 1


def _encode(table: pa.Table) -> pa.Table:
    """A shard's texts in a fixed order, as numbers of its distinct words, with the words' buckets."""
    rows = sorted(zip(table.column("h").to_pylist(), table.column("doc_id").to_pylist(), table.column("text").to_pylist(), table.column("y").to_pylist(), strict=True), key=lambda r: r[:2])
    vocab: dict[bytes, int] = {}
    ids, starts = _flat([r[2] for r in rows], vocab)
    buckets = np.array([pieces(w) if w else [0] * PIECES for w in vocab], np.uint16)
    del vocab
    give_back()
    packed = (ids.astype(np.int32), starts.astype(np.int32), buckets, np.array([r[3] for r in rows], np.uint8))
    return pa.table({"shard": table.column("shard").slice(0, 1), **{n: pa.array([v.tobytes()], pa.binary()) for n, v in zip(("ids", "starts", "buckets", "y"), packed, strict=True)}})


SHARDS = "shard int, ids binary, starts binary, buckets binary, y binary"
SUMS = "shard int, n double, small binary, emb binary, squares binary, moved binary"


def epoch(s: State, ids: np.ndarray, starts: np.ndarray, table: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float, rng: np.random.Generator, moved: np.ndarray) -> None:
    """Adam on the weighted logistic loss, once over a shard; through the maximum only the winning windows have a gradient."""
    ends = np.append(starts[1:], len(ids))
    order = rng.permutation(len(y))
    f = np.arange(FILTERS)
    for at in range(0, len(order), 32):
        docs = order[at : at + 32]
        lens = ends[docs] - starts[docs]
        begin = np.cumsum(lens) - lens
        words, pos = np.unique(np.concatenate([ids[starts[d] : ends[d]] for d in docs]), return_inverse=True)
        doc = np.repeat(np.arange(len(docs)), lens)
        filters, bias, out = s.parts()
        x = s.emb[table[words]].sum(axis=1)
        ys = _responses(np.concatenate([x @ r for r in filters.astype(np.float32)], axis=1)[pos], begin)
        tops = [np.maximum.reduceat(v, begin, axis=0) for v in ys]
        h = np.maximum(np.concatenate(tops, axis=1) + bias, 0)
        p = 1 / (1 + np.exp(-np.clip(h @ out + s.small[0, -1], -30, 30)))
        err = (p - y[docs]) * weight[y[docs]] / len(docs)
        back = err[:, None] * out * (h > 0)
        g_filters = 1e-4 * filters
        where, grads = [], []
        row = 0
        for k, (w, v, top) in enumerate(zip(WIDTHS, ys, tops, strict=True)):
            hit_p, hit_f = np.nonzero(v == top[doc])
            first = np.empty((len(docs), FILTERS), np.int64)
            key, one = np.unique(doc[hit_p] * FILTERS + hit_f, return_index=True)  # hits come by place: the first one of each
            first.ravel()[key] = hit_p[one]
            b = back[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(w):
                q = pos[np.minimum(first + j, len(pos) - 1)]
                g_filters[row + j] += np.einsum("dfk,df->kf", x[q], b)
                where.append(q.ravel())
                grads.append((filters[row + j].T[f] * b[:, :, None]).reshape(-1, DIM))
            row += w
        s.step += 1
        g = np.concatenate([g_filters.ravel(), back.sum(axis=0), h.T @ err + 1e-4 * out, [err.sum()]])
        value, m1, m2 = s.small
        m1 += 0.1 * (g - m1)
        m2 += 0.001 * (g**2 - m2)
        value -= rate * (m1 / (1 - 0.9**s.step)) / (np.sqrt(m2 / (1 - 0.999**s.step)) + 1e-8)
        cells, inv = np.unique(table[words[np.concatenate(where)]].ravel(), return_inverse=True)
        grads = np.repeat(np.concatenate(grads), PIECES, axis=0)
        total = np.stack([np.bincount(inv, grads[:, k], len(cells)) for k in range(DIM)], axis=1)
        live = np.flatnonzero((total != 0).any(axis=1) & (cells > 0))  # padding is not learned
        cells, total = cells[live], total[live]
        s.squares[cells] += (total**2).mean(axis=1)
        s.emb[cells] -= 3 * rate * total / (np.sqrt(s.squares[cells])[:, None] + 1e-6)
        moved[cells] += 1


def _shard_epochs(sent, weight: np.ndarray, rates: list[float], seed: int):
    """Each shard learns from the common state; what it sends are its numbers, weighted by its texts or by how often they moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in batches:
            for r in range(b.num_rows):
                shard = b.column("shard")[r].as_py()
                ids, starts, y = (np.frombuffer(b.column(c)[r].as_py(), t) for c, t in (("ids", np.int32), ("starts", np.int32), ("y", np.uint8)))
                table = np.frombuffer(b.column("buckets")[r].as_py(), np.uint16).reshape(-1, PIECES)
                emb, squares, small, step = sent.value
                s, moved = State(emb.copy(), squares.copy(), small.copy(), step), np.zeros(BUCKETS, np.float32)
                for k, rate in enumerate(rates):
                    epoch(s, ids, starts, table, y, weight, rate, np.random.default_rng([seed, shard, int(step), k]), moved)
                values = (s.small * len(y), s.emb * moved[:, None], s.squares * moved, moved)
                yield pa.RecordBatch.from_pydict(
                    {"shard": pa.array([shard], pa.int32()), "n": [float(len(y))], **{c: pa.array([v.tobytes()], pa.binary()) for c, v in zip(("small", "emb", "squares", "moved"), values, strict=True)}}
                )

    return run


def _add(table: pa.Table) -> pa.Table:
    """The sum of some shards, in their order."""
    table = table.sort_by("shard")
    out = {"shard": pa.array([table["shard"][0].as_py() // GROUP_SHARDS], pa.int32()), "n": [float(sum(table["n"].to_pylist()))]}
    for c, kind in (("small", np.float64), ("emb", np.float32), ("squares", np.float32), ("moved", np.float32)):
        total = sum(np.frombuffer(v.as_py(), kind).astype(float) for v in table[c])
        out[c] = pa.array([total.astype(kind).tobytes()], pa.binary())
    return pa.table(out)


def train(shards: DataFrame, count: int, texts: tuple[int, int], rate: float = 0.02, seed: int = 6) -> Model:
    """Learn from all encoded shards: in each round every shard takes its texts once, from the mean of all shards' last numbers.

    Sums are added up on the executors, some shards at a time in their order; the driver gets model-sized rows only. A row of
    the embeddings is the mean over the shards that moved it, by how often. Either label has half of the weight. texts: by label.
    """
    state = State.fresh(seed)
    if not all(texts):
        state.parts()[2][:] = 0
        state.small[0, -1] = (30.0 if texts[1] else -30.0) if any(texts) else 0.0
        return state.model()
    weight = sum(texts) / (2.0 * np.array(texts))
    epochs = max(LEAST_EPOCHS, min(EPOCHS, -(-LEARNED // sum(texts))))
    rates = [rate * (1 - 0.8 * e / epochs) for e in range(epochs)]
    for some in [rates] if count == 1 else [[r] for r in rates]:
        sent = shards.sparkSession.sparkContext.broadcast((state.emb, state.squares, state.small, state.step))
        rows, left = shards.mapInArrow(_shard_epochs(sent, weight, some, seed), SUMS), count
        while left > 1:
            rows, left = rows.groupBy(F.floor(F.col("shard") / GROUP_SHARDS)).applyInArrow(_add, SUMS), -(-left // GROUP_SHARDS)
        r = rows.first()
        sent.destroy()
        moved = np.frombuffer(r.moved, np.float32)
        at = np.flatnonzero(moved)
        state.emb[at] = np.frombuffer(r.emb, np.float32).reshape(-1, DIM)[at] / moved[at, None]
        state.squares[at] = np.frombuffer(r.squares, np.float32)[at] / moved[at]
        state.small = np.frombuffer(r.small).reshape(3, SMALL) / r.n
        state.step += len(some) * max(1, -(-sum(texts) // (32 * count)))
    return state.model()


def calibrate(scored: DataFrame, least: int = 50) -> dict[str | None, float]:
    """Per language the threshold of the best F1 on the rows (lang, score, y), the middle of its best range; None: over all.

    Languages with fewer than ``least`` rows of either label take the one over all. Rows are counted by score, to a part in ``BINS``.
    """
    bins = scored.groupBy("lang", F.floor(F.col("score") * BINS).alias("bin")).agg(
        F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"), F.min("score").alias("low"), F.max("score").alias("high")
    )
    sums = [F.sum(c).alias(c) for c in ("n0", "n1")]
    common = bins.groupBy("lang").agg(*sums).where("lang is not null and lang <> ''").where(F.least("n0", "n1") >= least).orderBy(F.desc(F.least("n0", "n1")), "lang").limit(LANGS)
    every = bins.groupBy("bin").agg(*sums, F.min("low").alias("low"), F.max("high").alias("high")).withColumn("lang", F.lit(None).cast("string"))
    by: dict[str | None, list] = {}
    for r in every.unionByName(bins.join(F.broadcast(common.select("lang")), "lang")).collect():
        by.setdefault(r.lang, []).append((r.low, r.high, r.n0, r.n1))

    def best(rows: list) -> float:
        low, high, n0, n1 = (np.array(c, float) for c in zip(*sorted(rows), strict=True))
        start, stop = np.append(0.0, high), np.append(low, 1.0)  # a cut lies between the scores of two bins
        tp, hit = (np.append(np.cumsum(n[::-1])[::-1], 0) for n in (n1, n0 + n1))
        f1 = 2 * tp / np.maximum(1, hit + n1.sum())
        at = np.flatnonzero(f1 == f1.max())
        k = at[np.argmax((stop - start)[at])]
        return float((start[k] + stop[k]) / 2)

    labels = [sum(r[c] for r in by.get(None, [])) for c in (2, 3)]
    return {k: best(v) for k, v in by.items()} if all(labels) else {None: 0.5}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", seed: int = 6, shard_rows: int = SHARD_ROWS, ws: Workspace | None = None) -> Model:
    """Fit on all labelled documents outside the held-out fold (crc32 of the id, mod 5, is 0), long texts too.

    A quarter of them, by a hash of the id, calibrates the thresholds; the weights learn from all others. Of an id with several
    labels the largest counts, of one with several texts the least. Texts stay on the executors: they are dealt to shards of
    some ``shard_rows`` by hashes of their ids, and encoded once.
    """
    small_batches(docs.sparkSession)
    ws = ws or Workspace(docs.sparkSession, "toxicity")
    able = labels.where(F.col(label).isin(0, 1)).where(fold() != 0).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    # ids and labels alone: as long as they are few, texts need no shuffle to meet them
    able = F.broadcast(able) if able.count() <= SENT_LABELS else able
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), lang.alias("lang")).join(able, "doc_id").withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    checks = F.pmod("h", F.lit(4)) == 3
    size = rows.where(~checks).groupBy("y").agg(F.count_distinct("doc_id").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()
    texts = tuple(sum(r.n for r in size if r.y == v) for v in (0, 1))
    count = max(1, sum(texts) // shard_rows, sum(r["size"] or 0 for r in size) // SHARD_BYTES)
    one = F.min(F.struct("text", "lang", "y", "h")).alias("r")
    dealt = rows.where(~checks).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(count)).cast("int")).repartition(count, "shard")
    encoded = dealt.groupBy("shard", "doc_id").agg(one).select("shard", "doc_id", "r.text", "r.y", "r.h").groupBy("shard").applyInArrow(_encode, SHARDS)
    shards = ws.save(encoded, "shards") if all(texts) else encoded
    model = train(shards, count, texts, seed=seed)
    scored = rows.where(checks).groupBy("doc_id").agg(one).select(F.col("r.text").alias("text"), F.col("r.lang").alias("lang"), F.col("r.y").alias("y"))
    scored = scored.mapInArrow(_scores(model, "text"), "lang string, y int, score double, words boolean")
    model.thresholds = calibrate(ws.save(scored, "scored"))  # counted more than once, scored once
    return model


def _scores(model: Model, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded, known = model.folded(), Pieces()
        for batch in slices(batches, column):
            texts = batch.column(column).cast(pa.binary()).to_pylist()
            out = np.zeros(len(texts))
            start = 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and (end == start or size + len(texts[end] or b"") <= 6 * WORDS_AT_ONCE):
                    size += len(texts[end] or b"")
                    end += 1
                out[start:end] = logits(model, folded, texts[start:end], known)
                start = end
            score = 1 / (1 + np.exp(-out.clip(-30, 30)))
            keep = [c for c in batch.schema.names if c != "text"]
            words = pa.array([bool(t) and not t.isspace() for t in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score, pa.float64()), words], names=[*keep, "score", "words"])

    return run


def threshold(model: Model, lang: Column) -> Column:
    out = F.lit(model.thresholds[None])
    for name, value in sorted((k, v) for k, v in model.thresholds.items() if k is not None):
        out = F.when(lang == name, F.lit(value)).otherwise(out)
    return out


def score_toxicity(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """doc_id, score and rejected for each row of ``docs`` (doc_id, text, lang; more are ignored).

    A text is words over hashed embeddings, convolved at widths 1, 2 and 3; each filter's maximum
    over the whole text feeds a logistic output. The score uses the text alone; ``rejected`` compares
    it with the calibrated threshold of the row's language (null or rare: the one over all). ``keep``:
    columns to return unchanged, in place of doc_id alone. Null and empty texts are one window of padding and get a
    score; texts without words are never rejected. Repeated rows get equal scores.
    """
    small_batches(docs.sparkSession)
    keep = keep or ["doc_id"]
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    kinds = {k: t for k, t in docs.dtypes if k in keep} | {"doc_id": "long"}
    # kept columns travel under names of their own, as the text does
    column = "kept_text" if kinds.get("text") == "string" else "text"  # a text that goes along goes once
    rows = docs.select(*(F.col(k).cast(kinds[k]).alias(f"kept_{k}") for k in keep), lang.alias("lang"), *([F.col("text").cast("binary").alias("text")] if column == "text" else []))
    # the model is of a fixed size: a few megabytes for each task
    scored = rows.mapInArrow(_scores(model, column), ", ".join([*(f"kept_{k} {kinds[k]}" for k in keep), "lang string, score double, words boolean"]))
    cut = threshold(model, F.col("lang"))
    return scored.select(*(F.col(f"kept_{k}").alias(k) for k in keep), "score", cut.alias("threshold"), (F.col("words") & (F.col("score") >= cut)).alias("rejected"))
