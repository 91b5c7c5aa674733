"""One incremental pass: from files and cursors to delivered requests, stored records, new cursors and a summary."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import prepare_session
from ..functions.text import decode_project_dir, session_id
from ..operators.batches import dry_run, dry_summary, format_summary, privacy_gate, project_filter, run_summary
from ..operators.budget import FIRST_CAP, RECORD_BYTES, REQUEST_BYTES, REQUEST_RECORDS, SECOND_CAP, assemble_chunks, pack_chunks, prepare_records
from ..operators.cursors import classify_outcomes, file_results
from ..operators.dedup import dedup_batches, first_records, record_key
from ..operators.identity import build_requests
from ..operators.records import mark_lines, serialise
from ..sources.store import BUCKETS, append_records, known_keys, read_or_empty, stored_records
from ..sources.transcripts import add_cursors, drop_folder, is_whole, list_folders, load_cursors, new_ranges, read_lines
from .delivery import Sender, deliver_requests

BATCH = "account string, session_id string, start long, sha256 string"
MANIFEST = "manifest"


@dataclass
class Tables:
    """Folders of the stored records, of the cursors, of the batches delivered before, and of work between steps; all shared by executors.

    Of a committed pass only the results and the work tables in ``keep`` stay.
    """

    store: str
    cursors: str
    work: str
    history: str = ""
    keep: Sequence[str] = ()
    buckets: int = BUCKETS

    def __post_init__(self) -> None:
        self.history = self.history or f"{self.cursors}-batches"

    def stored(self, spark: SparkSession) -> DataFrame:
        return stored_records(spark, self.store)


@dataclass
class Limits:
    """Budgets of records and requests."""

    record_bytes: int = RECORD_BYTES
    request_bytes: int = REQUEST_BYTES
    first_cap: int = FIRST_CAP
    second_cap: int = SECOND_CAP
    request_records: int = REQUEST_RECORDS
    attempts: int = 4


@dataclass
class Run:
    """What a pass did: its key, a row of totals, their line of text, and a row for each file (of a dry run: what would be sent of it)."""

    key: str
    summary: DataFrame
    line: DataFrame
    files: DataFrame


class Work:
    """The tables of one pass by its key: those that are whole are not made again."""

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.at = spark, f"{folder}/{key}"

    def keep(self, df: DataFrame | Callable[[], DataFrame], name: str) -> DataFrame:
        """The table if it is whole, else that of ``df``, which is called only then if it is a function."""
        if is_whole(self.spark, f"{self.at}/{name}"):
            return (self.spark.read if callable(df) else self.spark.read.schema(df.schema)).parquet(f"{self.at}/{name}")
        return self.again(df() if callable(df) else df, name)

    def again(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.at}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{name}")


def sweep(spark: SparkSession, work: str) -> None:
    """Delete what committed passes left in a work folder, but for what their manifests name. Passes that are not committed keep all."""
    for key in list_folders(spark, work):
        at = f"{work}/{key}"
        if is_whole(spark, f"{at}/{MANIFEST}"):
            named = spark.read.json(f"{at}/{MANIFEST}").first()
            for name in list_folders(spark, at):
                if name != MANIFEST and name not in (named["keep"] or []):
                    drop_folder(spark, f"{at}/{name}")


def file_batches(marked: DataFrame) -> DataFrame:
    """Counts, attribution, digest and extent of each file with a valid record, in one aggregate without payload.

    ``marked``: lines as ``read_lines`` gives them, marked by ``mark_lines``; the row with a sha256 is the range's end.
    """
    line = F.col("sha256").isNull()
    first = lambda c: F.min_by(F.struct(c), F.when(F.col(c).isNotNull(), F.col("line_no")))[c]
    last = lambda c: F.max_by(F.struct(c), F.when(F.col(c).isNotNull(), F.col("line_no")))[c]
    return (
        marked.groupBy("file_path", "start", "lines_before")
        .agg(
            F.count_if(line & F.col("valid")).alias("record_count"),
            F.count_if(line & ~F.col("blank") & ~F.col("valid")).alias("skipped_lines"),
            first("cwd").alias("cwd"),
            last("git_branch").alias("git_branch"),
            F.max("sha256").alias("sha256"),
            F.max(F.when(~line, F.col("byte_start") - F.col("start"))).alias("new_bytes"),
            F.max(F.when(~line, F.col("line_no"))).alias("new_lines"),
        )
        .where("record_count > 0")
        .withColumn("session_id", session_id(F.col("file_path")))
        .withColumn("project_path", F.coalesce("cwd", decode_project_dir(F.col("file_path"))))
        .drop("cwd")
    )


def gated_batches(ranges: DataFrame, repos: DataFrame, project: str | None = None) -> DataFrame:
    """Batches of the ranges that pass filter and gate: all that is shuffled before the gate are counts."""
    return privacy_gate(project_filter(file_batches(mark_lines(read_lines(ranges))), project), repos)


def _struct(values: dict[str, str | None]):
    return F.struct(*(F.lit(v).cast("string").alias(k) for k, v in values.items()))


def ingest(
    spark: SparkSession, files: DataFrame, repos: DataFrame, tables: Tables, project: str | None = None, on_shrink: str = "restart",
    sender: Sender | None = None, limits: Limits | None = None, dry: bool = False, commit_cursors: bool = True, key: str | None = None,
) -> Run:
    """Deliver and store what is new in ``files`` (file_path, length).

    Only new bytes are read, where they lie: first for the counts that the gate needs, then those of gated
    files for their records. A batch that was delivered before (of the same session, place and bytes) is a duplicate, and not sent.
    Records of the others are cut to their budgets, packed and sent as requests: a file's chunks in order, none behind one that failed, and
    its cursor moves only if none failed. Records
    of delivered chunks that the store does not know are stored first and cursors moved after them, so a pass
    that dies between the two is repeated, and finds its records known. ``commit_cursors=False`` stops there, as such a
    pass would. ``dry``: say what would be sent of each file, and write nothing but work tables.

    A pass with a ``key`` that died goes on where it stopped: tables that are whole, attempts included, are not made again. One that is
    committed gives its results and does nothing.
    """
    prepare_session(spark)
    sender, limits = sender or Sender(), limits or Limits()
    work = Work(spark, tables.work, key or uuid.uuid4().hex[:12])
    name = work.at.rsplit("/", 1)[1]
    if is_whole(spark, f"{work.at}/{MANIFEST}"):
        return _recorded(spark, work.at, name)
    keep = work.keep
    cursors = load_cursors(spark, tables.cursors)
    ranges = keep(new_ranges(files, cursors, on_shrink), "ranges")
    batches = keep(gated_batches(ranges, repos, project), "batches")
    if dry:
        summary = dry_summary(batches)
        return Run(name, summary, format_summary(summary, dry=True), dry_run(batches))
    account = sender.account.get("vendorAccountId")
    history = read_or_empty(spark, tables.history, BATCH).where(F.lit(account).eqNullSafe(F.col("account")))
    judged = keep(dedup_batches(batches, history, ("session_id", "start", "sha256")), "judged")
    ours = batches.join(judged.where("accepted"), "file_path", "left_semi")
    # up to the bytes that were counted, even if a file has grown since
    consumed = ours.select("file_path", "start", (F.col("start") + F.col("new_bytes")).alias("end"), "lines_before")
    rows = serialise(mark_lines(read_lines(consumed).where("sha256 is null"))).withColumn("record_key", record_key("byte_start"))
    prepared = keep(prepare_records(rows, limits.record_bytes, limits.request_bytes, limits.first_cap, limits.second_cap), "prepared")
    chunks = keep(pack_chunks(prepared, limits.request_bytes, limits.request_records), "chunks")
    about = ours.select("file_path", "session_id", "project_path", "git_remote", "git_branch", "sha256")
    requests = keep(build_requests(assemble_chunks(prepared, chunks), about, _struct(sender.machine), _struct(sender.account)), "requests")
    attempts = deliver_requests(requests, sender, limits.attempts, keep)
    decided = classify_outcomes(attempts, limits.attempts, ("file_path", "chunk_no"))
    # a request without any attempt was not sent
    decided = keep(chunks.select("file_path", "chunk_no").distinct().join(decided, ["file_path", "chunk_no"], "left").withColumn("ok", F.coalesce(F.col("outcome") == "ok", F.lit(False))), "decided")
    failed = decided.where("not ok").groupBy("file_path").agg(F.min("chunk_no").alias("first_failed"))
    placed = prepared.select("record_key", "uuid", "file_path", "line_no", "byte_start").join(chunks, ["file_path", "line_no"]).join(failed, "file_path", "left")
    sent = keep(placed.where("first_failed is null or chunk_no < first_failed").drop("first_failed"), "sent")
    # from here on the store decides, which a pass that died may have written already
    first = work.again(first_records(sent.select("record_key", "file_path", "byte_start"), "byte_start"), "first")
    known = known_keys(first.select("record_key"), tables.store, work.again, tables.buckets)
    fresh = work.again(first.join(known, "record_key", "left_anti"), "fresh")
    got = sent.join(fresh.withColumn("new", F.lit(1)), ["record_key", "file_path", "byte_start"], "left").groupBy("file_path", "chunk_no").agg(
        F.count("new").alias("inserted"), (F.count("*") - F.count("new")).alias("deduped")
    )
    error = F.when(~F.col("ok"), F.concat(F.coalesce("outcome", F.lit("not sent")), F.lit(" failure, status "), F.coalesce(F.col("status").cast("string"), F.lit("none")), F.lit(", chunk "), F.col("chunk_no").cast("string")))
    outcomes = decided.join(got, ["file_path", "chunk_no"], "left").select("file_path", "chunk_no", F.when(F.col("ok"), F.lit(200)).otherwise(F.lit(500)).alias("status"), "inserted", "deduped", error.alias("error"))
    delivered = file_results(outcomes).withColumn("duplicate", F.lit(False))
    none, zero = F.lit(None), F.lit(0).cast("long")
    twice = batches.join(judged.where("not accepted"), "file_path", "left_semi").select(
        "file_path", F.lit(True).alias("ok"), zero.alias("chunks"), zero.alias("inserted"), F.col("record_count").alias("deduped"),
        none.cast("long").alias("first_failed"), none.cast("string").alias("error"), F.lit(True).alias("duplicate"),
    )
    results = work.again(delivered.unionByName(twice), "results")
    stored = prepared.join(fresh, ["record_key", "file_path", "byte_start"]).join(batches.select("file_path", "session_id", "project_path"), "file_path")
    append_records(stored, tables.store, fresh.count(), tables.buckets)
    total = run_summary(batches, results).first().asDict()
    if commit_cursors:
        done = batches.join(results.where("ok"), "file_path", "left_semi")
        moved = done.select(
            "file_path",
            (F.col("start") + F.col("new_bytes")).alias("bytes_uploaded"),
            (F.col("lines_before") + F.col("new_lines")).alias("lines_uploaded"),
            F.col("sha256").alias("sha256_of_last_upload"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("last_run_at"),
        )
        fully = done.join(results.where("not duplicate"), "file_path", "left_semi")
        fully.select(F.lit(account).cast("string").alias("account"), "session_id", "start", "sha256").write.mode("append").parquet(tables.history)
        add_cursors(moved, tables.cursors)
        kept = sorted({"results", *tables.keep})
        spark.createDataFrame([(name, kept, json.dumps(total))], "key string, keep array<string>, summary string").coalesce(1).write.mode("overwrite").json(f"{work.at}/{MANIFEST}")
        for table in list_folders(spark, work.at):
            if table not in (*kept, MANIFEST):
                drop_folder(spark, f"{work.at}/{table}")
    return _run(spark, name, total, results)


def _run(spark: SparkSession, key: str, total: dict[str, int], files: DataFrame) -> Run:
    summary = spark.createDataFrame([tuple(total.values())], ", ".join(f"{c} long" for c in total))
    return Run(key, summary, format_summary(summary), files)


def _recorded(spark: SparkSession, at: str, key: str) -> Run:
    told = spark.read.json(f"{at}/{MANIFEST}").first()
    kind = "file_path string, ok boolean, chunks long, inserted long, deduped long, first_failed long, error string, duplicate boolean"
    return _run(spark, key, json.loads(told["summary"]), read_or_empty(spark, f"{at}/results", kind))


def run_pass(spark: SparkSession, files: DataFrame, repos: DataFrame, tables: Tables, project: str | None = None, **more) -> DataFrame:
    """The totals of a pass (see ``ingest``); of a dry one, what would be sent of each file."""
    run = ingest(spark, files, repos, tables, project, **more)
    return run.files if more.get("dry") else run.summary
