"""Comparing all members of large groups in blocks, without one task holding a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_pairs(rows: DataFrame, group: str, member: str, size: str, least: int = 64, most: int = 8192) -> DataFrame:
    """Deal the rows of each group into blocks, and send every block to each pair of blocks.

    Adds ``blk``, ``bi`` and ``bj`` (bi <= bj): rows that share (group, bi, bj) are to be compared,
    inside the block where bi = bj, across blocks (blk = bi against blk = bj) otherwise. Each pair
    of rows meets exactly once. A group of ``size`` rows has blocks of about 2 * sqrt(size) rows, at most ``most``, which
    bounds a task: neither it nor the number of copies of a row grows in proportion to the group up to ``most`` ** 2 / 4
    rows (17 million); beyond, copies grow with the group.
    """
    width = F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(2 * F.sqrt(size)).cast("int")))
    n = F.greatest(F.lit(1), F.ceil(F.col(size) / width)).cast("int")
    dealt = rows.withColumn("n_blk", n).withColumn("blk", F.pmod(F.xxhash64(member), F.col("n_blk")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blk") - 1))
    return (
        dealt.withColumn("o", other)
        .withColumn("bi", F.least("blk", "o"))
        .withColumn("bj", F.greatest("blk", "o"))
        .drop("o", "n_blk")
        .repartition(group, "bi", "bj")
        .sortWithinPartitions(group, "bi", "bj", "blk", member)
    )


def each_group(
    batches: Iterator[pa.RecordBatch], keys: list[str], compare: Callable[[pa.Table], pa.RecordBatch | None]
) -> Iterator[pa.RecordBatch]:
    """Call ``compare`` for each run of equal keys in sorted batches; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[start] for c in cols)
            if held and key != last:
                if (out := compare(pa.Table.from_batches(held))) is not None:
                    yield out
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held and (out := compare(pa.Table.from_batches(held))) is not None:
        yield out
