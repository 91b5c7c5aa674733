"""One row for each file's new lines, its attribution and the gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import decode_project_dir, non_empty, session_id


def build_batches(lines: DataFrame, parsed: DataFrame) -> DataFrame:
    """Counts and attribution for each file with a valid record.

    ``lines``: file_path, line_no, byte_len (all of them); ``parsed``: of the non-blank ones,
    with valid, cwd and git_branch. The project is the cwd of the first record that has one, else what
    the folder's name says; the branch is the last record's that has one. Files without a valid
    record drop out, with their malformed lines, and are read again another time. Payload takes no
    part in the shuffle.
    """
    totals = lines.groupBy("file_path").agg(F.count("*").alias("new_lines"), F.sum(F.col("byte_len") + 1).alias("new_bytes"))
    return counts(parsed).join(totals, "file_path")


def counts(parsed: DataFrame) -> DataFrame:
    return (
        parsed.groupBy("file_path")
        .agg(
            F.count_if("valid").alias("record_count"),
            F.count_if(~F.col("valid")).alias("skipped_lines"),
            F.expr("min_by(cwd, line_no) FILTER (WHERE cwd IS NOT NULL)").alias("cwd"),
            F.expr("max_by(git_branch, line_no) FILTER (WHERE git_branch IS NOT NULL)").alias("git_branch"),
        )
        .where("record_count > 0")
        .select(
            "file_path",
            session_id(F.col("file_path")).alias("session_id"),
            F.coalesce("cwd", decode_project_dir(F.col("file_path"))).alias("project_path"),
            "git_branch",
            "record_count",
            "skipped_lines",
        )
    )


def normalise_repos(repos: DataFrame) -> DataFrame:
    """Remote and branch trimmed, empty ones missing; one row for each path, its least values."""
    clean = lambda c: non_empty(F.trim(c)).alias(c)
    return repos.select("project_path", clean("remote"), clean("branch")).groupBy("project_path").agg(F.min("remote").alias("remote"), F.min("branch").alias("branch"))


def project_filter(batches: DataFrame, part: str | None) -> DataFrame:
    """Batches whose project path contains ``part``, literally; none or '' keeps all."""
    return batches.where(F.contains("project_path", F.lit(part))) if part else batches


def privacy_gate(batches: DataFrame, repos: DataFrame) -> DataFrame:
    """Batches whose project has a remote, with it; the branch of the records goes before the repository's."""
    known = normalise_repos(repos).where("remote IS NOT NULL")
    return batches.join(known, "project_path").withColumn("git_branch", F.coalesce("git_branch", "branch")).withColumnRenamed("remote", "git_remote").drop("branch")


def dry_run(batches: DataFrame) -> DataFrame:
    return batches.select("session_id", "record_count", "skipped_lines", "project_path")


def dry_summary(batches: DataFrame) -> DataFrame:
    """Totals of what a dry run would send."""
    return batches.agg(
        F.count("*").alias("scanned_files"),
        F.coalesce(F.sum("record_count"), F.lit(0)).cast("long").alias("records_sent"),
        F.coalesce(F.sum("skipped_lines"), F.lit(0)).cast("long").alias("skipped_lines"),
    )


def run_summary(batches: DataFrame, results: DataFrame) -> DataFrame:
    """One row of totals. ``batches`` passed all filters; ``results``: file_path, ok, inserted, deduped.

    Records of failed files count as sent, what was inserted of them does not; batches without a result
    are neither uploaded nor failed. If ``results`` say which are duplicates, these are counted beside the accepted ones.
    """
    joined = batches.join(results, "file_path", "left")
    long = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    tried = F.col("ok").isNotNull()
    return joined.agg(
        F.count("*").alias("scanned_files"),
        F.count_if("ok").alias("uploaded_files"),
        F.count_if(~F.col("ok")).alias("failed_files"),
        long(F.sum(F.when(tried, F.col("record_count"))), "records_sent"),
        long(F.sum(F.when(F.col("ok"), F.col("inserted"))), "inserted"),
        long(F.sum(F.when(F.col("ok"), F.col("deduped"))), "deduped"),
        long(F.sum("skipped_lines"), "skipped_lines"),
        *([F.count_if(F.col("ok") & ~F.col("duplicate")).alias("accepted_files"), F.count_if("duplicate").alias("duplicate_files")] if "duplicate" in results.columns else []),
    )


def _if_any(c: str, words: str) -> Column:
    return F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(words)))


def format_summary(summary: DataFrame, dry: bool = False) -> DataFrame:
    """One line of text for each summary; failed and malformed only if there are any."""
    text = lambda c: F.col(c).cast("string")
    if dry:
        sent = F.concat(F.lit("dry-run: "), text("scanned_files"), F.lit(" file(s), "), text("records_sent"), F.lit(" new record(s) would be sent"))
        return summary.select(F.concat_ws(", ", sent, _if_any("skipped_lines", " malformed skipped")).alias("summary"))
    files = F.concat(text("uploaded_files"), F.lit("/"), text("scanned_files"), F.lit(" file(s) uploaded"))
    parts = [files, F.concat(text("inserted"), F.lit(" inserted")), F.concat(text("deduped"), F.lit(" deduped"))]
    return summary.select(F.concat_ws(", ", *parts, _if_any("failed_files", " failed"), _if_any("skipped_lines", " malformed skipped")).alias("summary"))
