"""Parsing lines into records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.helpers import compacted, second_look
from ..functions.session import check_session
from ..functions.text import is_compact, is_json, string_field, trimmed, wrapped


def mark_lines(lines: DataFrame) -> DataFrame:
    """All lines, trimmed, with blank, valid, uuid, cwd, git_branch and compact (the text is its value's compact form).

    Any JSON value is a record; the three fields are set where an object has them as non-empty
    strings. A line is parsed once; those that the built-in check refuses get a second look by a strict
    parser, which sees only them.
    """
    check_session(lines.sparkSession)
    raw = F.col("raw")
    seen = (
        lines.withColumn("raw", trimmed(raw))
        .withColumn("blank", raw == "")
        .withColumn("parsed", F.when(~F.col("blank"), wrapped(raw)))
        .withColumn("fast", is_json(raw, F.col("parsed")))
        .withColumn("look", second_look(F.when(~F.col("fast") & ~F.col("blank"), raw)))
    )
    pick = lambda field, name: F.when(F.col("fast"), string_field(F.col("parsed"), name)).otherwise(F.col(f"look.{field}")).alias(field)
    return seen.select(
        *lines.columns,
        "blank",
        (F.col("fast") | F.coalesce("look.valid", F.lit(False))).alias("valid"),
        pick("uuid", "uuid"),
        pick("cwd", "cwd"),
        pick("git_branch", "gitBranch"),
        (F.col("fast") & is_compact(raw, F.col("parsed"))).alias("compact"),
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """Non-blank lines with valid, uuid, cwd and git_branch."""
    return mark_lines(lines).where("not blank").drop("blank", "compact")


def serialise(marked: DataFrame) -> DataFrame:
    """The valid records of marked lines with ``record``, the compact text that goes over the wire, and its bytes.

    Most lines are compact already; only the others go to Python.
    """
    text = F.when(F.col("compact"), F.col("raw")).otherwise(compacted(F.when(~F.col("compact"), F.col("raw"))))
    return marked.where("valid").withColumn("record", text).withColumn("wire_bytes", F.octet_length("record").cast("long")).drop("blank", "valid", "compact")


def parse_records(lines: DataFrame) -> DataFrame:
    """The valid records, with their size on the wire: bytes of the compact text."""
    return serialise(mark_lines(lines)).drop("record")
