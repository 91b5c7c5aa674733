"""Kinds of texts, learned without labels from counts of hashed words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 256
KINDS = 4


@dataclass
class Kinds:
    """A mixture of multinomials over buckets of short words."""

    logs: np.ndarray  # kind x bucket
    prior: np.ndarray

    def joint(self, x: np.ndarray) -> np.ndarray:
        return x @ self.logs.T + np.log(self.prior)

    def of(self, x: np.ndarray) -> np.ndarray:
        return self.joint(x).argmax(axis=1)


#: Shares of texts are whole numbers of this part, so that sums are exact in any order.
UNIT = 1 << 20


def _expectation(kinds: Kinds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(kinds.prior), BUCKETS + 1), np.int64)
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                x = np.frombuffer(b"".join(b.column("vector").slice(s, 4096).to_pylist()), "<u2").reshape(-1, BUCKETS).astype(float)
                joint = kinds.joint(x)
                post = np.exp(joint - joint.max(axis=1, keepdims=True))
                post = np.rint(post / post.sum(axis=1, keepdims=True) * UNIT)
                sums[:, :BUCKETS] += (post.T @ x).astype(np.int64)  # exact: below 2 ** 53
                sums[:, BUCKETS] += post.sum(axis=0).astype(np.int64)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"at": at.astype(np.int32), "value": sums.reshape(-1)[at]})

    return run


def learn_kinds(vectors: DataFrame, kinds: int = KINDS, rounds: int = 8, seed: int = 3) -> Kinds:
    """Expectation maximization over the vectors of all training texts; sums are added up on the executors, and are the same however the texts are dealt.

    It starts from the common mean, told apart along the buckets in which texts differ most; without texts all kinds are alike.
    """
    now = Kinds(np.log(np.full((1, BUCKETS), 1 / BUCKETS)), np.ones(1))
    rng = np.random.default_rng(seed)
    for r in range(rounds + 1):
        rows = vectors.mapInArrow(_expectation(now), "at int, value long").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
        both = np.zeros((len(now.prior), BUCKETS + 1))
        for x in rows:
            both.reshape(-1)[x["at"]] = float(x["value"]) / UNIT
        sums, mass = both[:, :BUCKETS], both[:, BUCKETS]
        if r == 0:
            # each kind favours a part of the common buckets; what occurs together pulls texts apart from there
            mean = (sums[0] + 0.1) / (sums[0] + 0.1).sum()
            order = np.argsort(-mean)
            tilt = np.ones((kinds, BUCKETS))
            tilt[rng.integers(0, kinds, BUCKETS), order] = 3.0
            tilt[np.arange(min(kinds, BUCKETS)) % kinds, order[: min(kinds, BUCKETS)]] = 6.0
            share = mean * tilt
            now = Kinds(np.log(share / share.sum(axis=1, keepdims=True)), np.full(kinds, 1 / kinds))
        else:
            now = Kinds(np.log((sums + 0.1) / (sums + 0.1).sum(axis=1, keepdims=True)), (mass + 1) / (mass + 1).sum())
    return now
