"""Connected components of a distributed edge list, by alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index reachable over the pairs (i, j) of n local nodes, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while (root != (up := root[root])).any():
            root = up
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return root


def _stars(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """Least neighbour (or itself) of every node ``u``, aggregated map-side and stored.

    Stored, so that the joins on ``u`` have plain exchanges on both sides, whose hot
    partitions Spark can split.
    """
    return ws.save(edges.groupBy("u").agg(F.min("v").alias("m")), name)


def connected_components(edges: DataFrame, ws: Workspace, name: str = "cc") -> DataFrame:
    """``(id, component)`` for every id of ``edges(a, b)``; component is its least id.

    Large-star and small-star steps alternate until the edges no longer change; every step
    moves edges only, never a node's neighbour list, and the number of rounds grows with the
    logarithm of the longest chain. Loops (a = b) and null ends are ignored; no edges give no
    rows.
    """
    now = ws.save(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        f"{name}_0",
    )
    k, done = 0, now.isEmpty()
    while not done:
        k += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _stars(both, ws, f"{name}_l{k}").select("u", F.least("u", "m").alias("m"))
        large = ws.save(
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
            f"{name}_a{k}",
        )
        least = _stars(large, ws, f"{name}_s{k}")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = ws.save(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), f"{name}_{k}")
        for old in (f"{name}_{k - 1}", f"{name}_l{k}", f"{name}_a{k}", f"{name}_s{k}"):
            ws.drop(old)
        now = new
        # done when every node has one edge down at most, and none of those that have one is the end of another
        ends = now.select(F.col("u").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(now.select(F.col("v").alias("id"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        nodes = ends.groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        done = nodes.where("down > 1 OR (down = 1 AND up = 1)").agg(F.count("*")).first()[0] == 0
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
