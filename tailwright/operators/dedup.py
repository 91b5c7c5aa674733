"""Deduplication of records and batches against what is stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def record_key(line: str = "line_no") -> Column:
    """The uuid, else a hash of file, line and text: a line sent again is known, a like line is not."""
    own = F.sha2(F.concat_ws("|", "file_path", F.col(line).cast("string"), "raw"), 256)
    return F.coalesce("uuid", own)


def first_records(incoming: DataFrame, line: str = "line_no") -> DataFrame:
    """Of each record_key the first row by (file_path, ``line``), without payload; a key that many rows share is thinned out map-side."""
    first = incoming.groupBy("record_key").agg(F.min(F.struct("file_path", line)).alias("first"))
    return first.select("record_key", "first.file_path", f"first.{line}")


def new_records(incoming: DataFrame, store: DataFrame, line: str = "line_no") -> DataFrame:
    """Of each record_key not in ``store``, the first row by (file_path, ``line``), without payload.

    ``incoming``: record_key, file_path and the place of a line. Only keys are shuffled; join the payload to the
    result.
    """
    return first_records(incoming, line).join(store.select("record_key"), "record_key", "left_anti")


def dedup_counts(incoming: DataFrame, fresh: DataFrame) -> DataFrame:
    """Per file: records inserted, and records known already or repeated."""
    sent = incoming.groupBy("file_path").agg(F.count("*").alias("sent"))
    got = fresh.groupBy("file_path").agg(F.count("*").alias("inserted"))
    inserted = F.coalesce("inserted", F.lit(0)).cast("long")
    return sent.join(got, "file_path", "left").select("file_path", inserted.alias("inserted"), (F.col("sent") - inserted).alias("deduped"))


def dedup_batches(batches: DataFrame, history: DataFrame, by: Sequence[str] = ("sha256",)) -> DataFrame:
    """file_path, sha256 and whether the batch is accepted: of the least path among those alike in ``by``, and new to ``history``.

    Batches of equal bytes are alike by default; a pass also asks for the same session and place, as a session may well append the same bytes twice.
    """
    first = batches.groupBy(*by).agg(F.min("file_path").alias("first"))
    known = history.select(*by).distinct().withColumn("known", F.lit(True))
    accepted = (F.col("file_path") == F.col("first")) & F.col("known").isNull()
    return batches.select("file_path", *by).join(first, list(by)).join(known, list(by), "left").select("file_path", "sha256", accepted.alias("accepted"))
