"""Splitting slices of files into complete lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed


def _pieces():
    # one character for each byte, so that lengths are bytes and no byte is lost
    return F.split(F.decode("content", "ISO-8859-1"), "\n", -1)


def consumed_bytes():
    """Bytes up to and with the last newline of ``content``."""
    last = F.element_at(_pieces(), -1)
    return (F.octet_length("content") - F.length(last)).cast("long")


def split_lines(files: DataFrame) -> DataFrame:
    """file_path, line_no (from 0), byte_len and raw of every line that a newline ends; further columns go along.

    What follows the last newline is still being written and is left out. Invalid UTF-8 becomes
    U+FFFD in ``raw``, while byte_len counts the bytes of the file.
    """
    pieces = _pieces()
    complete = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    rest = [c for c in files.columns if c != "content"]
    return (
        files.where(F.octet_length("content") > 0)
        .select(*rest, F.posexplode(complete).alias("line_no", "piece"))
        .select(
            *rest,
            F.col("line_no").cast("long"),
            F.length("piece").cast("long").alias("byte_len"),
            F.make_valid_utf8(F.encode("piece", "ISO-8859-1").cast("string")).alias("raw"),
        )
    )


def line_offsets(lines: DataFrame, slices: Sequence[str] = ("file_path",)) -> DataFrame:
    """Adds byte_start and byte_end (behind the newline), relative to the slice. Give it narrow rows."""
    up_to = Window.partitionBy(*slices).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("byte_len") + 1).over(up_to)
    return lines.withColumn("byte_end", end).withColumn("byte_start", F.col("byte_end") - F.col("byte_len") - 1)


def non_blank(lines: DataFrame) -> DataFrame:
    """Lines with more than white space; ``raw`` is trimmed."""
    return lines.withColumn("raw", trimmed(F.col("raw"))).where("raw <> ''")


def batch_sha256(files: DataFrame) -> DataFrame:
    """file_path, consumed bytes and sha256 of exactly these, of each slice with a complete line."""
    return (
        files.withColumn("consumed", consumed_bytes())
        .where("consumed > 0")
        .select("file_path", "consumed", F.sha2(F.expr("substring(content, 1, CAST(consumed AS INT))"), 256).alias("sha256"))
    )
