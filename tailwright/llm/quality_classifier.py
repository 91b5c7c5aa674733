"""Quality classifier: a sparse ensemble of rules over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, pieces

#: Labelled rows that the ensemble is fitted on at most: half of them of either label.
FIT_ROWS = 20_000
STATISTICS = (
    "log_words", "word_length", "upper_share", "digit_share", "symbol_share", "mark_share", "doubled_share", "separator_share",
    "line_words", "ended_share", "repeated_line_share", "distinct_share", "top_share", "pair_share", "stop_share",
)

_UPPER = bytes(set(range(256)) - set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_DIGITS = bytes(set(range(256)) - set(b"0123456789"))
_SYMBOLS = bytes(set(range(256)) - set(b"#*$%&|<>{}[]\\^~_=+@/"))
_MARKS = bytes(set(range(256)) - set(b".,;:!?"))
_DOUBLED = (b"!!", b"??", b"**", b"$$", b"%%", b"##", b"&&")
_SEPARATORS = {b"|", b">", b"<", b"/", b"-", b"*"}


def statistics(text: bytes | None) -> list[float]:
    """Statistics of one whole text, all finite; zeros where a text has no words."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = Counter(words)
    pairs = Counter(zip(words[:-1], words[1:], strict=True))
    size = sum(map(len, words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    count = lambda drop: len(text.translate(None, drop))
    ended = sum(x.rstrip().endswith((b".", b"!", b"?", b'"')) for x in lines)
    return [
        float(np.log1p(n)),
        size / n,
        count(_UPPER) / size,
        count(_DIGITS) / size,
        count(_SYMBOLS) / n,
        count(_MARKS) / n,
        sum(text.count(d) for d in _DOUBLED) / n,
        sum(counts[s] for s in _SEPARATORS if s in counts) / n,
        float(np.log1p(n / len(lines))),
        ended / len(lines),
        1 - len(set(lines)) / len(lines),
        len(counts) / n ** 0.8,
        max(counts.values()) / n,
        sum(c for c in pairs.values() if c > 1) / n,
        sum(c for w, c in counts.items() if len(w) <= 3) / n,
    ]


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        rows = np.array([statistics(t.as_py()) for t in b.column("text")]).reshape(-1, len(STATISTICS))
        keep = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(rows[:, k]) for k in range(len(STATISTICS)))], names=[*keep, *STATISTICS])


def with_statistics(docs: DataFrame, more: str = "") -> DataFrame:
    """doc_id and the statistics, from doc_id, text and the columns named in the schema ``more``."""
    names = [x.split()[0] for x in more.split(",") if x.strip()]
    rows = docs.select(F.col("doc_id").cast("long"), *names, F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_stats, ", ".join(["doc_id long", *([more] if more else []), *(f"{s} double" for s in STATISTICS)]))


Rule = tuple[tuple[int, bool, float], ...]  # conditions (statistic, above, cut), all to hold


@dataclass
class Ensemble:
    rules: list[tuple[Rule, float]]
    linear: list[tuple[int, float, float, float]]  # statistic, low, high, weight of the clipped value
    bias: float

    def column(self) -> Column:
        """The score as one Spark column expression over the statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = None
            for k, above, cut in rule:
                one = F.col(STATISTICS[k]) > F.lit(cut) if above else F.col(STATISTICS[k]) <= F.lit(cut)
                holds = one if holds is None else holds & one
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        for k, low, high, weight in self.linear:
            total = total + F.least(F.greatest(F.col(STATISTICS[k]), F.lit(low)), F.lit(high)) * F.lit(weight)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def grow(x: np.ndarray, residual: np.ndarray, curvature: np.ndarray, depth: int, least: int, cuts: list[np.ndarray]) -> list[tuple[Rule, np.ndarray, float]]:
    """A regression tree on the residuals; every path below the root, with its rows and its value."""
    out: list[tuple[Rule, np.ndarray, float]] = []

    def split(rows: np.ndarray, path: Rule) -> None:
        if path:
            out.append((path, rows, residual[rows].sum() / (curvature[rows].sum() + 1.0)))
        if len(path) == depth or len(rows) < 2 * least:
            return
        best = (1e-9, -1, 0.0)
        g, h = residual[rows], curvature[rows]
        base = g.sum() ** 2 / (h.sum() + 1.0)
        for k in range(x.shape[1]):
            if not len(cuts[k]):
                continue
            at = np.searchsorted(cuts[k], x[rows, k], side="left")  # rows <= cut j have at <= j
            size = len(cuts[k]) + 1
            gs, hs, ns = (np.cumsum(np.bincount(at, v, size))[:-1] for v in (g, h, np.ones(len(rows))))
            gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - base
            gain[(ns < least) | (len(rows) - ns < least)] = 0
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (float(gain[j]), k, float(cuts[k][j]))
        if best[1] < 0:
            return
        _, k, cut = best
        above = x[rows, k] > cut
        split(rows[~above], (*path, (k, False, cut)))
        split(rows[above], (*path, (k, True, cut)))

    split(np.arange(len(x)), ())
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias under an l1 penalty, by accelerated proximal gradient steps."""
    n, p = z.shape
    w, b = np.zeros(p), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v = np.ones(p) / np.sqrt(p)
    for _ in range(20):
        v = z.T @ (z @ v)
        norm = np.linalg.norm(v) or 1.0
        v /= norm
    rate = 1 / (0.25 * (norm / n + 1))
    pw, pb, t = w.copy(), b, 1.0
    for _ in range(steps):
        err = 1 / (1 + np.exp(-np.clip(z @ pw + pb, -30, 30))) - y
        nw = pw - rate * (z.T @ err) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nb = pb - rate * err.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 5e-4, seed: int = 4) -> Ensemble:
    """Boosted shallow trees give the rules; the lasso keeps few of them, and some clipped linear terms."""
    if not len(y) or y.min() == y.max():
        return Ensemble([], [], (30.0 if y.min() else -30.0) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    cuts = []
    for k in range(x.shape[1]):
        u = np.unique(np.quantile(x[:, k], np.linspace(0.005, 0.995, 120)))
        cuts.append((u[:-1] + u[1:]) / 2)
    raw = np.zeros(len(y))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        rows = np.sort(rng.choice(len(y), max(1, int(0.6 * len(y))), replace=False))
        p = 1 / (1 + np.exp(-raw))
        paths = grow(x[rows], (y - p)[rows], (p * (1 - p))[rows], depth, max(2, len(rows) // 500), cuts)
        parents = {path[:-1] for path, _, _ in paths}
        for path, _, value in paths:
            rules.setdefault(path)
            if path not in parents:
                raw += 0.3 * np.clip(value, -4, 4) * holds(path, x)
    names = list(rules)
    z = np.stack([holds(r, x) for r in names], axis=1).astype(float) if names else np.zeros((len(y), 0))
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    spread = np.clip(x, low, high).std(axis=0)
    flat = spread < 1e-12
    lin = 0.4 * np.clip(x, low, high) / np.where(flat, 1, spread)
    lin[:, flat] = 0
    mean = np.concatenate([z.mean(axis=0), lin.mean(axis=0)])
    w, b = lasso_logistic(np.concatenate([z, lin], axis=1) - mean, y, penalty)
    b -= float(mean @ w)
    kept = [(r, float(v)) for r, v in zip(names, w[: len(names)], strict=True) if v]
    linear = [(k, float(low[k]), float(high[k]), float(0.4 * w[len(names) + k] / spread[k])) for k in range(x.shape[1]) if not flat[k] and w[len(names) + k]]
    return Ensemble(kept, linear, float(b))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, cut in rule:
        out &= (x[:, k] > cut) if above else (x[:, k] <= cut)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS, seed: int = 4) -> Ensemble:
    """Fit on the statistics of at most ``rows`` labelled documents, half of either label.

    They are taken by a hash of the id, never from the held-out fold (crc32 of the id, mod 5, is 0);
    the texts are measured where they lie and only their statistics reach the driver.
    """
    able = labels.where(F.col(label).isin(0, 1)).where(fold() != 0).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))  # of several labels the largest
    chosen = None
    for value in (0, 1):
        half = able.where(F.col("y") == value).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows // 2)
        chosen = half if chosen is None else chosen.unionByName(half)
    # at most ``rows`` ids: small enough to broadcast at any size of the corpus
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    got = sorted(with_statistics(some, "y int").collect())
    x = np.array([[r[s] for s in STATISTICS] for r in got]).reshape(-1, len(STATISTICS))
    return fit_rules(x, np.array([r["y"] for r in got], float), seed=seed)


def score_quality(docs: DataFrame, ensemble: Ensemble) -> DataFrame:
    """doc_id and score for each row of ``docs`` (doc_id, text; more are ignored).

    Statistics of the whole text alone enter the score; the rules are one column expression. Null
    and empty texts have statistics of zero and a score like others. Repeated rows get equal scores;
    an empty table gives no rows.
    """
    return with_statistics(docs).select("doc_id", ensemble.column().alias("score"))
