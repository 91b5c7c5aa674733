"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clusters import BUCKETS, Kinds, learn_kinds
from .common import Workspace, pieces, small_batches
from .texts import word_hashes, words_of

TOPICS = 8
#: Bytes of the words that tell topics apart, at least.
LONG = 7
#: Values of a dimension with marginals of their own; the rest, by tokens, share the value ''.
CATEGORIES = 2000
#: Target shares are observed shares of tokens to this power, as usual for multilingual mixtures.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.7}
#: Share of all tokens that is kept at least, also where only fewer would have all target shares.
BUDGET = 0.6
ROUNDS = 200
TOLERANCE = 1e-9
OTHER = ""


_EDGE = np.zeros(256, bool)
_EDGE[list(b".,;:!?\"')")] = True


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each text, and the vector of its longer words, which carry the subject."""
    for b in pieces(batches, rows=1000, size=4 << 20):
        words, at = words_of(b.column("text"))
        tokens, n = np.diff(at), b.num_rows
        ends = np.frombuffer(words.buffers()[1], np.int32)[1 : len(words) + 1].astype(np.int64)
        sizes = np.diff(np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1])
        if len(words):
            data = np.frombuffer(words.buffers()[2], np.uint8)
            marked = _EDGE[data[ends - 1]]  # a mark at the end does not count
        else:
            marked = np.zeros(0, bool)
        long_ = np.flatnonzero(sizes - marked >= LONG)
        cut = words.take(pa.array(long_))
        lengths = (sizes - marked)[long_]
        if len(long_):
            own = np.frombuffer(cut.buffers()[1], np.int32)[: len(cut) + 1].astype(np.int64)
            data = np.frombuffer(cut.buffers()[2], np.uint8)
            kept = np.arange(own[-1]) - np.repeat(own[:-1], np.diff(own)) < np.repeat(lengths, np.diff(own))
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            cut = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(offsets), pa.py_buffer(data[: own[-1]][kept])])
        bucket = (word_hashes(cut) % np.uint64(BUCKETS)).astype(np.int64)
        text = np.repeat(np.arange(n), tokens)[long_]
        x = np.minimum(np.bincount(text * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS), 65535).astype("<u2")
        vectors = [v.tobytes() if any_ else None for v, any_ in zip(x, x.any(axis=1).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("lang"), pa.array(vectors, pa.binary()), pa.array(tokens, pa.int64()), b.column("draw")], names=["doc_id", "source", "lang", "vector", "n_tokens", "draw"])


def _assign(kinds: Kinds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vector = b.column("vector")
            has = vector.is_valid().to_numpy(zero_copy_only=False)
            topic = np.full(b.num_rows, "none", object)
            if has.any():
                x = np.frombuffer(b"".join(vector.drop_null().to_pylist()), "<u2").reshape(-1, BUCKETS).astype(float)
                topic[has] = [f"t{k}" for k in kinds.of(x).tolist()]
            names = ["doc_id", "source", "lang", "n_tokens", "draw"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:3]), pa.array(topic, pa.string()), *(b.column(c) for c in names[3:])], names=[*names[:3], "topic", *names[3:]])

    return run


def draw_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A uniform number below one that rests on id and text alone."""
    return F.pmod(F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string")), F.lit(1 << 53)) / float(1 << 53)


def measured(docs: DataFrame, ws: Workspace, topics: int = TOPICS) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens (words) and a uniform draw that rests on id and text.

    Topics are the parts of a mixture of multinomials over hashed longer words, learned from all texts without labels by
    expectation maximization; texts without longer words have the topic 'none'.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) if c in docs.columns else F.lit("unknown")
    rows = docs.select(F.col("doc_id").cast("long"), text("source").alias("source"), text("lang").alias("lang"), F.col("text").cast("binary").alias("text"), draw_of().alias("draw"))
    seen = ws.save(rows.mapInArrow(_measure, "doc_id long, source string, lang string, vector binary, n_tokens long, draw double"), "seen")
    kinds = learn_kinds(seen.where("vector is not null").select("vector"), topics)
    return seen.mapInArrow(_assign(kinds), "doc_id long, source string, lang string, topic string, n_tokens long, draw double")


@dataclass
class Mixture:
    """Fitted factors: a document's weight is the product over its values."""

    factors: dict[str, dict[str, float]]
    top: float
    error: float
    rounds: int
    #: A row is kept with the product of these over its values as probability, one at most.
    chances: dict[str, dict[str, float]] = field(default_factory=dict)
    #: Expected share of the tokens that is kept.
    rate: float = 1.0
    #: By dimension and value: the target share that the kept tokens miss by over 1 %, and the share they have.
    unmet: dict[str, dict[str, tuple[float, float]]] = field(default_factory=dict)


def _indexed(cells: list[tuple], tokens: np.ndarray, targets: dict[str, dict[str, float]]) -> tuple[list, list, list, list]:
    """By dimension: its values, the one of each cell, which of them have tokens and a target, and their targets, of sum 1."""
    names, at, has, goal = [], [], [], []
    for k, d in enumerate(targets):
        own = sorted({c[k] for c in cells})
        index = {v: i for i, v in enumerate(own)}
        names.append(own)
        at.append(np.array([index[c[k]] for c in cells], int))
        g = np.array([max(0.0, targets[d].get(v, 0.0)) for v in own])
        fit = np.array([v in targets[d] for v in own], bool) & (np.bincount(at[k], tokens, len(own)) > 0)
        fit &= bool(g[fit].sum())
        has.append(fit)
        goal.append(np.where(fit, g, 0) / (g[fit].sum() or 1))
    return names, at, has, goal


def rake(cells: list[tuple], tokens: np.ndarray, targets: dict[str, dict[str, float]], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Mixture:
    """Scale each dimension in turn to its target shares until all hold.

    cells: tuples of values, in the order of ``targets``. Values without tokens or without a target
    are left out of the fit and keep factor 1; targets are scaled to one over the others, and are shares of
    the others' tokens. ``top`` is the largest weight of a cell, ``error`` the largest difference of a
    share from its target at the end.
    """
    dims = list(targets)
    names, at, has, goal = _indexed(cells, tokens, targets)
    w = np.ones(len(cells))
    factor = [np.ones(len(n)) for n in names]
    done, error = 0, 0.0
    total = tokens.sum()
    share = lambda k: np.bincount(at[k], w * tokens, len(names[k])) / total
    while total and done < rounds:
        done += 1
        for k in range(len(dims)):
            now = share(k)
            step = np.divide(goal[k] * now[has[k]].sum(), now, out=np.ones_like(now), where=has[k] & (now > 0))
            factor[k] *= step
            w *= step[at[k]]
        error = max(float(np.abs(share(k) - goal[k] * share(k)[has[k]].sum())[has[k]].max(initial=0)) for k in range(len(dims)))
        if error < tolerance:
            break
    top = float(w[tokens > 0].max()) if total else 1.0
    return Mixture({d: dict(zip(n, f.tolist(), strict=True)) for d, n, f in zip(dims, names, factor, strict=True)}, top, error, done)


def _capped(goal: np.ndarray, have: np.ndarray, total: float) -> np.ndarray:
    """``total`` dealt in proportion to ``goal``, to none more than it has; what it lacks goes to the others."""
    out, free = np.zeros_like(have), goal > 0
    while free.any():
        left = total - out.sum()
        part = goal * (left / goal[free].sum())
        full = free & (part >= have)
        if not full.any():
            out[free] = part[free]
            break
        out[full] = have[full]
        free &= ~full
    return out


def _scaled(at: np.ndarray, q: np.ndarray, tokens: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Factors by value with which min(1, factor * q) of the tokens are the wanted ones.

    Newton's steps from below on a concave function of straight pieces end after as many as pieces.
    """
    count = lambda x: np.bincount(at, x, len(want))
    rising = count(q * tokens)
    f = np.divide(want, rising, out=np.ones_like(want), where=rising > 0)
    for _ in range(100):
        now = f[at] * q
        missing = want - count(np.minimum(1, now) * tokens)
        slope = count(np.where(now < 1, q, 0) * tokens)
        move = (missing > 1e-12 * want) & (slope > 0)
        if not move.any():
            break
        f[move] += missing[move] / slope[move]
    return f


def thin(m: Mixture, cells: list[tuple], tokens: np.ndarray, targets: dict[str, dict[str, float]], budget: float = BUDGET, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Mixture:
    """Chances to keep rows: weights over the largest one, if ``budget`` of the tokens or more are kept so.

    Else rare values of large weights would set the rate of all. Weights are then scaled until
    min(1, scaled weight) keeps ``budget`` of the tokens, and raked once more under this bound: a value
    with fewer tokens than its target is kept whole, what it lacks is dealt to the others in
    proportion, and ``unmet`` has the shares that come out.
    """
    dims = list(targets)
    names, at, has, goal = _indexed(cells, tokens, targets)
    factor = [np.array([m.factors[d][v] for v in n], float) for d, n in zip(dims, names, strict=True)]
    total = float(tokens.sum())
    if not total or not dims:
        m.chances = {d: dict(f) for d, f in m.factors.items()}
        return m
    product = lambda: np.prod([f[a] for f, a in zip(factor, at, strict=True)], axis=0)
    factor[0] /= m.top or 1.0
    q = product()
    if (q * tokens).sum() < budget * total:
        have = [np.bincount(a, tokens * (q > 0), len(n)) for a, n in zip(at, names, strict=True)]
        wanted = min(budget * total, float(tokens[q > 0].sum()))
        factor[0] *= _scaled(np.zeros(len(q), int), q, tokens, np.array([wanted]))[0]
        for _ in range(rounds):
            moved = 0.0
            for k in range(len(dims)):
                q = product()
                now = np.bincount(at[k], np.minimum(1, q) * tokens, len(names[k]))
                want = np.where(has[k], _capped(goal[k], have[k], max(0.0, wanted - now[~has[k]].sum())), now)
                moved = max(moved, float(np.abs(want - now).max()) / total)
                step = _scaled(at[k], q, tokens, want)
                factor[k] = np.where(has[k], np.clip(factor[k] * step, 0, 1e15), factor[k])
            if moved < tolerance:
                break
    chance = np.minimum(1, product()) * tokens
    m.rate = float(chance.sum() / total)
    m.chances = {d: dict(zip(n, f.tolist(), strict=True)) for d, n, f in zip(dims, names, factor, strict=True)}
    for k, d in enumerate(dims):
        got = np.bincount(at[k], chance, len(names[k]))
        got /= got[has[k]].sum() or 1
        m.unmet[d] = {names[k][i]: (float(goal[k][i]), float(got[i])) for i in np.flatnonzero(has[k] & (np.abs(got - goal[k]) > 0.01 * goal[k]))}
    return m


def _common(docs: DataFrame, dim: str, most: int) -> dict[str, int]:
    """The values with most tokens, at most ``most``, and their tokens; '' has those of all further values, if there are any."""
    counted = docs.groupBy(dim).agg(F.sum("n_tokens").alias("n")).where("n > 0")
    out = {r[dim]: r["n"] for r in counted.orderBy(F.desc("n"), dim).limit(most).collect()}
    if len(out) == most and (rest := counted.agg(F.sum("n")).first()[0] - sum(out.values())):
        out[OTHER] = out.get(OTHER, 0) + rest
    return out


def fit_mixture(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: dict[str, float] = TEMPER, most: int = CATEGORIES, budget: float = BUDGET) -> tuple[Mixture, DataFrame]:
    """The fitted mixture, and the measured ``docs`` with pooled values.

    ``targets``: shares of tokens by source, lang and topic; by default the observed shares,
    tempered; the values beyond the ``most`` common ones are one value, '', with the share of all of
    them. Values that given targets name are not pooled. The driver holds the table of cells: at most
    ``most`` values in a dimension, '' and those named, and at most as many cells as their combinations
    that occur.
    """
    dims = list(temper)
    pooled = docs
    goals: dict[str, dict[str, float]] = {}
    for d in dims:
        common = _common(docs, d, most)
        given = (targets or {}).get(d)
        if len(common) >= most:
            own = [(v,) for v in sorted({*common, *(given or {})})]
            pooled = pooled.join(F.broadcast(docs.sparkSession.createDataFrame(own, f"{d} string").withColumn(f"is_{d}", F.lit(True))), d, "left").withColumn(d, F.when(F.col(f"is_{d}"), F.col(d)).otherwise(F.lit(OTHER))).drop(f"is_{d}")
        total = sum(common.values()) or 1
        goals[d] = given or {v: (n / total) ** temper[d] for v, n in common.items()}
    cells = pooled.groupBy(*dims).agg(F.sum("n_tokens").alias("n")).where("n > 0").orderBy(*dims).collect()
    values, tokens = [tuple(r[d] for d in dims) for r in cells], np.array([r["n"] for r in cells], float)
    m = thin(rake(values, tokens, goals), values, tokens, goals, budget)
    for d, missed in m.unmet.items():
        if missed:
            worst = sorted(missed.items(), key=lambda x: (-abs(x[1][0] - x[1][1]), x[0]))[:10]
            logging.getLogger(__name__).warning("%d target shares of %s are not met at a keep rate of %.3f; (target, share): %s", len(missed), d, m.rate, dict(worst))
    return m, pooled


def mix_documents(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: dict[str, float] = TEMPER, topics: int = TOPICS, most: int = CATEGORIES, budget: float = BUDGET, ws: Workspace | None = None) -> DataFrame:
    """Calibrated weight, probability and verdict for every document.

    ``docs``: doc_id long, text, source and lang strings; further columns are ignored. Returns per
    row doc_id, source, lang, topic, n_tokens, weight, probability, draw (see ``draw_of``), kept. Topics are clusters
    of texts by their longer words, learned from all of them (see ``measured``). Weights are raked until the weighted tokens have the
    target share of each source, language and topic. The probability of a row is its weight over
    the largest one, if that keeps ``budget`` of the tokens or more; the kept tokens then have the target
    shares in expectation. Else rows of rare values are kept with probability 1 and the others so that ``budget``
    of the tokens are kept (see ``thin``); target shares that cannot be met are logged. A row is kept
    where a draw that rests on its id and text alone is below: any partitioning keeps the same rows.

    Null sources and languages are 'unknown'; texts without words (null, empty) have no tokens to weigh and keep
    weight 1 and probability 1. Repeated rows share a draw. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ws = ws or Workspace(spark, "mixing")
    m, pooled = fit_mixture(ws.save(measured(docs, ws, topics), "measured"), targets, temper, most, budget)
    weight = chance = F.lit(1.0)
    for d, factors in m.factors.items():
        part = [(v, f, m.chances[d][v]) for v, f in factors.items()]
        if part:
            # at most ``most`` rows, '' and those that targets name
            table = spark.createDataFrame(part, f"{d} string, f_{d} double, p_{d} double")
            pooled = pooled.join(F.broadcast(table), d, "left")
            weight = weight * F.coalesce(F.col(f"f_{d}"), F.lit(1.0))
            chance = chance * F.coalesce(F.col(f"p_{d}"), F.lit(1.0))
    empty = F.col("n_tokens") == 0
    probability = F.when(empty, F.lit(1.0)).otherwise(F.least(F.lit(1.0), chance))
    return (
        pooled.withColumn("weight", F.when(empty, F.lit(1.0)).otherwise(weight))
        .withColumn("probability", probability)
        .select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "draw", (F.col("draw") < F.col("probability")).alias("kept"))
    )
