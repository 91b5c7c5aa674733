"""Outcomes of deliveries and the cursors they move."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify_outcomes(attempts: DataFrame, most: int = 4, by: Sequence[str] = ("request_id",)) -> DataFrame:
    """Of each request (by default its request_id): attempts, status and outcome (ok, permanent, transient) of the attempt that decided.

    2xx is success; 4xx but 429 fails for good; anything else, no answer included, is tried again up
    to ``most`` attempts. Attempts after a decision do not count.
    """
    kind = (
        F.when(F.col("status").between(200, 299), "ok")
        .when(F.col("status").between(400, 499) & (F.col("status") != 429), "permanent")
        .otherwise("transient")
    )
    rows = attempts.where(F.col("attempt") <= most).withColumn("kind", kind)
    decided = F.expr("min_by(struct(attempt, status, kind), attempt) FILTER (WHERE kind <> 'transient')")
    last = F.expr("max_by(struct(attempt, status, kind), attempt)")
    return (
        rows.groupBy(*by)
        .agg(F.coalesce(decided, last).alias("d"))
        .select(*by, F.col("d.attempt").alias("attempts"), F.col("d.status").alias("status"), F.col("d.kind").alias("outcome"))
    )


def file_results(outcomes: DataFrame) -> DataFrame:
    """Per file: ok if all chunks succeeded, and what the chunks before the first failure stored.

    If ``outcomes`` have an error, that of the first failure goes along.
    """
    ok = F.col("status").between(200, 299)
    failed = outcomes.groupBy("file_path").agg(
        F.min(F.when(~F.coalesce(ok, F.lit(False)), F.col("chunk_no"))).alias("first_failed"),
        F.count("*").alias("chunks"),
    )
    counted = F.col("first_failed").isNull() | (F.col("chunk_no") < F.col("first_failed"))
    error = [F.max(F.when(F.col("chunk_no") == F.col("first_failed"), F.col("error"))).alias("error")] if "error" in outcomes.columns else []
    total = lambda c: F.coalesce(F.sum(F.when(counted, F.col(c))), F.lit(0)).cast("long").alias(c)
    return (
        outcomes.join(failed, "file_path")
        .groupBy("file_path", "first_failed", "chunks")
        .agg(total("inserted"), total("deduped"), *error)
        .select("file_path", F.col("first_failed").isNull().alias("ok"), "chunks", "inserted", "deduped", "first_failed", *(["error"] if error else []))
    )


def merge_cursors(cursors: DataFrame, advanced: DataFrame) -> DataFrame:
    """The cursor table with the rows of ``advanced`` (files that fully succeeded) in place of their old ones."""
    return cursors.join(advanced.select("file_path"), "file_path", "left_anti").unionByName(advanced.select(*cursors.columns))
