"""The registered queries of the transcript jobs, and the SQL that must give the same rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import prepare_session, work_folder
from ..functions.text import decode_project_dir, session_id, shed_string
from ..operators.batches import counts, dry_run, format_summary, privacy_gate, project_filter, run_summary
from ..operators.budget import assemble_chunks, pack_chunks, prepare_records
from ..operators.cursors import classify_outcomes, file_results, merge_cursors
from ..operators.dedup import dedup_batches, dedup_counts, new_records, record_key
from ..operators.identity import build_requests, machine_fingerprint, resolve_account
from ..operators.lines import batch_sha256, consumed_bytes, line_offsets, non_blank, split_lines
from ..operators.records import mark_lines, parse_lines, parse_records, serialise
from ..sources.transcripts import slice_at_cursor, valid_cursors
from ..sources.files import write_once
from ..sources.transcripts import list_transcripts, read_transcripts
from ..streaming.tail import tail
from ..streaming.watch import watch
from .delivery import Sender
from .fixtures import escaped, fixture, nested, with_fixtures
from .incremental import Limits, Tables, ingest

#: Budgets that make small tables exercise every branch.
REQUEST, RECORD, FIRST, SECOND, COUNT = 1500, 1200, 400, 100, 3

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Register a query under its name with its oracle over the fixtures."""

    def wrap(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(prepare_session(spark), sf_dir)
        ORACLES[f.__name__] = with_fixtures(sql)
        return f

    return wrap


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "lines")


def _doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "doc_files").withColumn("content", F.col("content").cast("binary"))


def _saved(df: DataFrame) -> DataFrame:
    """The table in the shared folder: what several branches of a plan read is worked out once."""
    path = work_folder(df.sparkSession, "saved")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(parse_lines(_lines(spark, sf_dir)))


# SQL shared by several oracles
PARSED = """parsed AS (
  SELECT file_path, line_no, trim(raw) AS raw, json_valid(raw) AS valid,
    CASE WHEN json_valid(raw) THEN nullif(json_extract_string(raw, '$.uuid'), '') END AS uuid,
    CASE WHEN json_valid(raw) THEN nullif(json_extract_string(raw, '$.cwd'), '') END AS cwd,
    CASE WHEN json_valid(raw) THEN nullif(json_extract_string(raw, '$.gitBranch'), '') END AS git_branch
  FROM lines WHERE trim(raw) <> '')"""
BATCHES = (
    PARSED
    + """, batches AS (
  SELECT file_path, replace(split_part(file_path, '/', 5), '.jsonl', '') AS session_id,
    coalesce(arg_min(cwd, line_no) FILTER (WHERE cwd IS NOT NULL), replace(split_part(file_path, '/', 4), '-', '/')) AS project_path,
    arg_max(git_branch, line_no) FILTER (WHERE git_branch IS NOT NULL) AS git_branch,
    count(*) FILTER (WHERE valid) AS record_count, count(*) FILTER (WHERE NOT valid) AS skipped_lines
  FROM parsed GROUP BY file_path HAVING count(*) FILTER (WHERE valid) > 0)"""
)
GATED = (
    BATCHES
    + """, gated AS (
  SELECT b.file_path, session_id, b.project_path, coalesce(git_branch, nullif(trim(branch), '')) AS git_branch, trim(remote) AS git_remote, record_count, skipped_lines
  FROM batches b JOIN repos r ON r.project_path = b.project_path AND nullif(trim(r.remote), '') IS NOT NULL)"""
)
RESULTS = """failed AS (
  SELECT file_path, min(chunk_no) FILTER (WHERE status NOT BETWEEN 200 AND 299) AS first_failed, count(*) AS chunks FROM outcomes GROUP BY file_path
), results AS (
  SELECT file_path, first_failed IS NULL AS ok, chunks,
    CAST(coalesce(sum(inserted) FILTER (WHERE first_failed IS NULL OR chunk_no < first_failed), 0) AS BIGINT) AS inserted,
    CAST(coalesce(sum(deduped) FILTER (WHERE first_failed IS NULL OR chunk_no < first_failed), 0) AS BIGINT) AS deduped, first_failed
  FROM outcomes JOIN failed USING (file_path) GROUP BY file_path, first_failed, chunks)"""
SUMMARY = (
    f"WITH {GATED}, {RESULTS}"
    + """, summary AS (
  SELECT count(*) AS scanned_files, count(*) FILTER (WHERE ok) AS uploaded_files, count(*) FILTER (WHERE NOT ok) AS failed_files,
    CAST(coalesce(sum(record_count) FILTER (WHERE ok IS NOT NULL), 0) AS BIGINT) AS records_sent,
    CAST(coalesce(sum(inserted) FILTER (WHERE ok), 0) AS BIGINT) AS inserted, CAST(coalesce(sum(deduped) FILTER (WHERE ok), 0) AS BIGINT) AS deduped,
    CAST(coalesce(sum(skipped_lines), 0) AS BIGINT) AS skipped_lines
  FROM gated LEFT JOIN results USING (file_path))"""
)
DOC_LINES = """pieces AS (
  SELECT file_path, string_split(content, chr(10)) AS p FROM doc_files
), split AS (
  SELECT file_path, CAST(unnest(range(len(p) - 1)) AS BIGINT) AS line_no, unnest(p[:len(p) - 1]) AS raw FROM pieces)"""


@query(f"WITH {DOC_LINES} SELECT file_path, line_no, CAST(strlen(raw) AS BIGINT) AS byte_len, raw FROM split")
def split_lines_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_lines(_doc_files(spark, sf_dir))


@query(
    f"""WITH {DOC_LINES} SELECT file_path, line_no, CAST(strlen(raw) AS BIGINT) AS byte_len,
  CAST(sum(strlen(raw) + 1) OVER w AS BIGINT) AS byte_end, CAST(sum(strlen(raw) + 1) OVER w - strlen(raw) - 1 AS BIGINT) AS byte_start
FROM split WINDOW w AS (PARTITION BY file_path ORDER BY line_no ROWS UNBOUNDED PRECEDING)"""
)
def line_offsets_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_offsets(split_lines(_doc_files(spark, sf_dir)).drop("raw"))


@query("SELECT file_path, line_no, raw FROM lines WHERE trim(raw) <> ''")
def blank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return non_blank(_lines(spark, sf_dir))


@query(f"WITH {PARSED} SELECT file_path, line_no, raw, uuid, cwd, git_branch, CAST(strlen(raw) AS BIGINT) AS wire_bytes FROM parsed WHERE valid")
def parse_records_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_records(_lines(spark, sf_dir))


@query(f"WITH {PARSED} SELECT file_path, count(*) AS malformed FROM parsed WHERE NOT valid GROUP BY file_path")
def malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(_lines(spark, sf_dir)).where(~F.col("valid")).groupBy("file_path").agg(F.count("*").alias("malformed"))


@query("""SELECT DISTINCT file_path, replace(split_part(file_path, '/', 5), '.jsonl', '') AS session_id, replace(split_part(file_path, '/', 4), '-', '/') AS decoded_path FROM lines""")
def session_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("file_path")
    return _lines(spark, sf_dir).select("file_path").distinct().select("file_path", session_id(path).alias("session_id"), decode_project_dir(path).alias("decoded_path"))


@query(f"WITH {BATCHES} SELECT * FROM batches")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir)


@query(f"WITH {BATCHES} SELECT file_path, project_path FROM batches")
def project_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir).select("file_path", "project_path")


@query(f"WITH {BATCHES} SELECT file_path, coalesce(b.git_branch, nullif(trim(branch), '')) AS git_branch FROM batches b LEFT JOIN repos r ON r.project_path = b.project_path")
def branch_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    repos = fixture(spark, sf_dir, "repos").select("project_path", F.nullif(F.trim("branch"), F.lit("")).alias("branch"))
    return _batches(spark, sf_dir).join(repos, "project_path", "left").select("file_path", F.coalesce("git_branch", "branch").alias("git_branch"))


@query(f"WITH {GATED} SELECT * FROM gated")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy_gate(_batches(spark, sf_dir), fixture(spark, sf_dir, "repos"))


@query(f"WITH {BATCHES} SELECT file_path, project_path FROM batches WHERE contains(project_path, 'app-1')")
def project_filter_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_filter(_batches(spark, sf_dir), "app-1").select("file_path", "project_path")


@query("""SELECT * FROM cursors WHERE lines_uploaded IS NOT NULL AND bytes_uploaded IS NOT NULL AND sha256_of_last_upload IS NOT NULL AND last_run_at IS NOT NULL""")
def cursor_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_cursors(fixture(spark, sf_dir, "cursors"))


@query(
    """WITH sliced AS (
  SELECT f.file_path, content, CAST(strlen(content) AS BIGINT) AS size, coalesce(bytes_uploaded, 0) AS pos, coalesce(lines_uploaded, 0) AS seen
  FROM doc_files f LEFT JOIN cursors c ON c.file_path = f.file_path AND lines_uploaded IS NOT NULL
), placed AS (SELECT file_path, content, size, CASE WHEN pos > size THEN 0 ELSE pos END AS start, CASE WHEN pos > size THEN 0 ELSE seen END AS lines_before FROM sliced)
SELECT file_path, start, lines_before, CASE WHEN start = 0 THEN content ELSE substr(content, length(split_part(content, chr(10), 1)) + 2) END AS content
FROM placed WHERE start < size"""
)
def cursor_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    cursors = valid_cursors(fixture(spark, sf_dir, "cursors"))
    sliced = slice_at_cursor(_doc_files(spark, sf_dir), cursors)
    return sliced.withColumn("content", F.col("content").cast("string"))


@query(
    f"""WITH {DOC_LINES}, joined AS (SELECT file_path, concat(string_agg(raw, chr(10) ORDER BY line_no), chr(10)) AS used FROM split GROUP BY file_path)
SELECT file_path, CAST(strlen(used) AS BIGINT) AS consumed, sha256(used) AS sha256 FROM joined"""
)
def batch_sha256_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_sha256(_doc_files(spark, sf_dir))


@query("""SELECT file_path, CASE WHEN strlen(content) > 400 THEN concat(left(content, 400), '…<truncated ', strlen(content) - strlen(left(content, 400)), ' bytes>') ELSE content END AS content FROM doc_files""")
def shed_string_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "doc_files").select("file_path", shed_string(F.col("content"), FIRST).alias("content"))


@query(f"WITH {PARSED} SELECT file_path, CAST(sum(strlen(raw)) AS BIGINT) AS wire_bytes, CAST(max(strlen(raw)) AS BIGINT) AS largest FROM parsed WHERE valid GROUP BY file_path")
def wire_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_records(_lines(spark, sf_dir)).groupBy("file_path").agg(F.sum("wire_bytes").alias("wire_bytes"), F.max("wire_bytes").alias("largest"))


def _cut(text: str, cap: int) -> str:
    return f"CASE WHEN strlen({text}) > {cap} THEN concat(left({text}, {cap}), '…<truncated ', strlen({text}) - strlen(left({text}, {cap})), ' bytes>') ELSE {text} END"


CUTS = f"""once AS (SELECT doc_id, source, lang, text, {_cut("text", FIRST)} AS text_1 FROM documents
), twice AS (SELECT *, {_cut("text_1", SECOND)} AS text_2 FROM once
), made AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS line_no, {nested("text")} AS r0, {nested("text_1")} AS r1, {nested("text_2")} AS r2 FROM twice
), prepared AS (SELECT concat('/t/nested/-srv-', source, '/n.jsonl') AS file_path, line_no, strlen(r0) > {RECORD} AS shed,
  CASE WHEN strlen(r0) <= {RECORD} THEN r0 WHEN strlen(r1) <= {REQUEST} THEN r1 ELSE r2 END AS record, r1 FROM made)"""


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "nested_records").withColumn("wire_bytes", F.octet_length("raw").cast("long"))


@query(f"WITH {CUTS} SELECT file_path, line_no, r1 AS record FROM prepared")
def shed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = prepare_records(_nested(spark, sf_dir), 0, 1 << 60, FIRST, SECOND)
    return cut.select("file_path", "line_no", "record")


@query(f"WITH {CUTS} SELECT file_path, line_no, record, CAST(strlen(record) AS BIGINT) AS wire_bytes, shed FROM prepared")
def prepare_records_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_records(_nested(spark, sf_dir), RECORD, REQUEST, FIRST, SECOND)


PACKED = f"""WITH RECURSIVE {PARSED}, r AS (
  SELECT file_path, line_no, raw, strlen(raw) AS sz, row_number() OVER (PARTITION BY file_path ORDER BY line_no) AS rn FROM parsed WHERE valid
), p AS (
  SELECT file_path, line_no, rn, sz AS acc, 1 AS cnt, CAST(0 AS BIGINT) AS chunk_no FROM r WHERE rn = 1
  UNION ALL
  SELECT r.file_path, r.line_no, r.rn, CASE WHEN p.acc + r.sz > {REQUEST} OR p.cnt >= {COUNT} THEN r.sz ELSE p.acc + r.sz END,
    CASE WHEN p.acc + r.sz > {REQUEST} OR p.cnt >= {COUNT} THEN 1 ELSE p.cnt + 1 END,
    CASE WHEN p.acc + r.sz > {REQUEST} OR p.cnt >= {COUNT} THEN p.chunk_no + 1 ELSE p.chunk_no END
  FROM p JOIN r ON r.file_path = p.file_path AND r.rn = p.rn + 1
)"""


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_records(_lines(spark, sf_dir)).withColumnRenamed("raw", "record")


@query(f"{PACKED} SELECT file_path, line_no, chunk_no FROM p")
def pack_chunks_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_chunks(_prepared(spark, sf_dir), REQUEST, COUNT)


@query(
    f"""{PACKED} SELECT file_path, chunk_no, count(*) AS n_records, CAST(sum(sz) AS BIGINT) AS chunk_bytes, string_agg(raw, ',' ORDER BY line_no) AS records
FROM p JOIN r USING (file_path, line_no) GROUP BY file_path, chunk_no"""
)
def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _saved(_prepared(spark, sf_dir))
    return assemble_chunks(rows, pack_chunks(rows, REQUEST, COUNT)).withColumn("records", F.array_join("records", ","))


@query("SELECT sha256(concat(install_id, '|', coalesce(hostname, ''))) AS fingerprint, hostname, os FROM machines")
def machine_fingerprint_of_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return machine_fingerprint(fixture(spark, sf_dir, "machines"))


@query(
    """SELECT coalesce(nullif(override_id, ''), nullif(account_uuid, ''), nullif(user_id, ''), concat('username:', coalesce(nullif(username, ''), 'unknown'))) AS account_id,
  CASE WHEN nullif(override_id, '') IS NULL AND coalesce(nullif(account_uuid, ''), nullif(user_id, '')) IS NOT NULL THEN nullif(email, '') END AS email,
  CASE WHEN nullif(override_id, '') IS NOT NULL THEN 'env' WHEN coalesce(nullif(account_uuid, ''), nullif(user_id, '')) IS NOT NULL THEN 'account-file' ELSE 'username' END AS source
FROM accounts"""
)
def resolve_account_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_account(fixture(spark, sf_dir, "accounts"))


@query(
    PACKED.replace(PARSED, GATED)
    + """, hashed AS (SELECT file_path, sha256(concat(string_agg(raw, chr(10) ORDER BY line_no), chr(10))) AS sha256 FROM lines GROUP BY file_path
), chunks AS (SELECT file_path, chunk_no, string_agg(raw, ',' ORDER BY line_no) AS records FROM p JOIN r USING (file_path, line_no) GROUP BY file_path, chunk_no)
SELECT file_path, chunk_no, concat('{"machine":{"fingerprint":"f1","os":"linux"},"account":{"vendor":"v","vendorAccountId":"a1"},"files":[{"providerSessionId":"', session_id,
  '","projectPathAbs":"', project_path, '","gitRemoteRaw":"', git_remote, '"', CASE WHEN git_branch IS NOT NULL THEN concat(',"gitBranch":"', git_branch, '"') ELSE '' END,
  ',"sha256":"', sha256, '","records":[', records, ']}]}') AS body
FROM chunks JOIN gated USING (file_path) JOIN hashed USING (file_path)"""
)
def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _saved(mark_lines(_lines(spark, sf_dir)))
    known = privacy_gate(counts(marked.where("not blank")), fixture(spark, sf_dir, "repos"))
    whole = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda x: x["raw"]), "\n"), F.lit("\n"))
    hashed = marked.groupBy("file_path").agg(F.sha2(whole, 256).alias("sha256"))
    rows = serialise(marked).select("file_path", "line_no", "record", "wire_bytes")
    chunks = assemble_chunks(rows, pack_chunks(rows, REQUEST, COUNT))
    machine = F.struct(F.lit("f1").alias("fingerprint"), F.lit(None).cast("string").alias("hostname"), F.lit("linux").alias("os"))
    account = F.struct(F.lit("v").alias("vendor"), F.lit("a1").alias("vendorAccountId"))
    return build_requests(chunks, known.join(hashed, "file_path"), machine, account)


KEYED = f"""{PARSED}, keyed AS (SELECT file_path, line_no, coalesce(uuid, sha256(concat_ws('|', file_path, line_no, raw))) AS record_key FROM parsed WHERE valid
), store AS (SELECT DISTINCT record_key FROM keyed WHERE line_no < 2
), fresh AS (SELECT record_key, file_path, line_no FROM (SELECT *, row_number() OVER (PARTITION BY record_key ORDER BY file_path, line_no) AS k FROM keyed) t WHERE k = 1 AND record_key NOT IN (SELECT record_key FROM store))"""


def _keyed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _saved(parse_lines(_lines(spark, sf_dir)).where("valid").select("file_path", "line_no", record_key().alias("record_key")))
    return rows, rows.where("line_no < 2")


@query(f"WITH {KEYED} SELECT * FROM fresh")
def dedup_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return new_records(*_keyed(spark, sf_dir))


@query(
    f"""WITH {KEYED} SELECT file_path, coalesce(n, 0) AS inserted, sent - coalesce(n, 0) AS deduped FROM (SELECT file_path, count(*) AS sent FROM keyed GROUP BY file_path) a
LEFT JOIN (SELECT file_path, count(*) AS n FROM fresh GROUP BY file_path) b USING (file_path)"""
)
def dedup_counts_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, store = _keyed(spark, sf_dir)
    return dedup_counts(rows, new_records(rows, store))


@query(
    """WITH hashed AS (SELECT file_path, sha256(content) AS sha256 FROM doc_files), history AS (SELECT DISTINCT sha256 FROM hashed WHERE file_path LIKE '%7.jsonl')
SELECT h.file_path, h.sha256, row_number() OVER (PARTITION BY h.sha256 ORDER BY h.file_path) = 1 AND k.sha256 IS NULL AS accepted FROM hashed h LEFT JOIN history k ON k.sha256 = h.sha256"""
)
def dedup_batches_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = _doc_files(spark, sf_dir).select("file_path", F.sha2("content", 256).alias("sha256"))
    return dedup_batches(hashed, hashed.where(F.endswith("file_path", F.lit("7.jsonl"))))


@query(f"WITH {RESULTS} SELECT * FROM results")
def file_results_of_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_results(fixture(spark, sf_dir, "outcomes"))


@query(
    """WITH kinds AS (SELECT *, CASE WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN status BETWEEN 400 AND 499 AND status <> 429 THEN 'permanent' ELSE 'transient' END AS kind FROM attempts WHERE attempt <= 4
), firsts AS (SELECT request_id, coalesce(min(attempt) FILTER (WHERE kind <> 'transient'), max(attempt)) AS attempt FROM kinds GROUP BY request_id)
SELECT request_id, attempt AS attempts, status, kind AS outcome FROM firsts JOIN kinds USING (request_id, attempt)"""
)
def classify_outcomes_of_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_outcomes(fixture(spark, sf_dir, "attempts"))


@query(
    f"""WITH {DOC_LINES}, moved AS (SELECT file_path, CAST(sum(strlen(raw) + 1) AS BIGINT) AS bytes_uploaded, count(*) AS lines_uploaded,
    sha256(concat(string_agg(raw, chr(10) ORDER BY line_no), chr(10))) AS sha256_of_last_upload, '2024-02-02T00:00:00.000Z' AS last_run_at
  FROM split WHERE file_path LIKE '%1.jsonl' GROUP BY file_path
), old AS (SELECT * FROM cursors WHERE lines_uploaded IS NOT NULL)
SELECT * FROM old WHERE file_path NOT IN (SELECT file_path FROM moved) UNION ALL SELECT * FROM moved"""
)
def merge_cursors_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _doc_files(spark, sf_dir).where(F.endswith("file_path", F.lit("1.jsonl")))
    lines = split_lines(files).groupBy("file_path").agg(F.sum(F.col("byte_len") + 1).alias("bytes_uploaded"), F.count("*").alias("lines_uploaded"))
    moved = lines.join(batch_sha256(files), "file_path").withColumn("last_run_at", F.lit("2024-02-02T00:00:00.000Z")).withColumnRenamed("sha256", "sha256_of_last_upload")
    return merge_cursors(valid_cursors(fixture(spark, sf_dir, "cursors")), moved)


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = privacy_gate(_batches(spark, sf_dir), fixture(spark, sf_dir, "repos"))
    return run_summary(known, file_results(fixture(spark, sf_dir, "outcomes")))


@query(f"{SUMMARY} SELECT * FROM summary")
def run_summary_of_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir)


@query(
    f"""{SUMMARY} SELECT concat(uploaded_files, '/', scanned_files, ' file(s) uploaded, ', inserted, ' inserted, ', deduped, ' deduped',
  CASE WHEN failed_files > 0 THEN concat(', ', failed_files, ' failed') ELSE '' END, CASE WHEN skipped_lines > 0 THEN concat(', ', skipped_lines, ' malformed skipped') ELSE '' END) AS summary FROM summary"""
)
def summary_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_summary(_summary(spark, sf_dir))


@query(f"WITH {GATED} SELECT session_id, record_count, skipped_lines, project_path FROM gated")
def dry_run_of_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dry_run(privacy_gate(_batches(spark, sf_dir), fixture(spark, sf_dir, "repos")))


def _files_written(spark: SparkSession, sf_dir: str) -> str:
    """The document files as real files in the shared folder; returns their root.

    Every row is a file, those of one path too: a task has its own folder, and in it one for each time that a path occurs.
    """
    root = work_folder(spark, "transcripts")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, met = TaskContext.get(), Counter()
        for batch in batches:
            for r in batch.to_pylist():
                path = r["file_path"]
                write_once(f"{root}/{task.partitionId()}/{met[path]}{path}", r["content"], str(task.taskAttemptId()))
                met[path] += 1
            yield pa.RecordBatch.from_pydict({"files": [batch.num_rows]})

    _doc_files(spark, sf_dir).select("file_path", "content").mapInArrow(write, "files long").agg(F.sum("files")).collect()
    return root


def _under(root: str):
    """The path of a file below the root, as the fixtures name it."""
    return F.concat(F.lit("/t/"), F.element_at(F.split(F.col("file_path"), "/t/"), -1))


@query("SELECT file_path, CAST(strlen(content) AS BIGINT) AS length, sha256(content) AS sha256 FROM doc_files")
def transcripts_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _files_written(spark, sf_dir)
    return read_transcripts(spark, root).select(_under(root).alias("file_path"), "length", F.sha2("content", 256).alias("sha256"))


@query(
    f"""WITH {DOC_LINES}, joined AS (SELECT file_path, concat(string_agg(raw, chr(10) ORDER BY line_no), chr(10)) AS used FROM split GROUP BY file_path)
SELECT file_path, CAST(0 AS BIGINT) AS start, CAST(strlen(used) AS BIGINT) AS consumed, sha256(used) AS sha256 FROM joined"""
)
def transcripts_tailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a one-shot stream reads of new files: all bytes up to the last newline."""
    root, out = _files_written(spark, sf_dir), work_folder(spark, "tailed")
    rows = tail(spark, root, f"{out}/log").select(_under(root).alias("file_path"), "start", consumed_bytes().alias("consumed"), F.sha2("content", 256).alias("sha256"))
    rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")


def _lines_written(spark: SparkSession, sf_dir: str) -> str:
    """The files of ``lines`` as real files in the shared folder; returns their root."""
    root = work_folder(spark, "sessions")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                write_once(root + r["file_path"], r["content"].encode(), str(TaskContext.get().taskAttemptId()))
            yield pa.RecordBatch.from_pydict({"files": [batch.num_rows]})

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda x: x["raw"])
    files = _lines(spark, sf_dir).groupBy("file_path").agg(F.concat(F.array_join(ordered, "\n"), F.lit("\n")).alias("content"))
    files.mapInArrow(write, "files long").agg(F.sum("files")).collect()
    return root


#: Records of gated files as the pass cuts them: their text is the last field of a line.
SENT_TEXT = f"""texts AS (
  SELECT p.*, json_extract_string(p.raw, '$.text') AS t FROM parsed p JOIN gated g ON g.file_path = p.file_path WHERE valid
), ends AS (SELECT *, {escaped("t")} AS e, {_cut("t", FIRST)} AS t1 FROM texts
), once AS (SELECT *, concat(left(raw, length(raw) - length(e) - 2), {escaped("t1")}, '"}}') AS r1, {_cut("t1", SECOND)} AS t2 FROM ends
), made AS (SELECT *, concat(left(raw, length(raw) - length(e) - 2), {escaped("t2")}, '"}}') AS r2 FROM once
), kept AS (SELECT file_path, line_no, uuid, CASE WHEN strlen(raw) <= {RECORD} THEN raw WHEN strlen(r1) <= {REQUEST} THEN r1 ELSE r2 END AS record FROM made)"""


@query(
    f"""WITH {GATED}, {SENT_TEXT}
SELECT count(*) AS stored, CAST(coalesce(sum(strlen(record)), 0) AS BIGINT) AS stored_bytes
FROM (SELECT record FROM kept QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY file_path, line_no) = 1) t"""
)
def transcripts_watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in the store, and their bytes, after two one-shot runs over the files of ``lines``, the second one with nothing new; long ones are cut as in any pass."""
    root, at = _lines_written(spark, sf_dir), work_folder(spark, "watch")
    tables = Tables(f"{at}/store", f"{at}/cursors", f"{at}/work", buckets=4)
    for _ in range(2):
        watch(spark, root, lambda: fixture(spark, sf_dir, "repos"), tables, f"{at}/checkpoint", seconds=None, limits=Limits(RECORD, REQUEST, FIRST, SECOND, COUNT)).awaitTermination()
    return tables.stored(spark).agg(F.count("*").alias("stored"), F.coalesce(F.sum(F.octet_length("record")), F.lit(0)).cast("long").alias("stored_bytes"))


@query(
    PACKED.replace(PARSED, GATED)
    + """, chunks AS (
  SELECT p.file_path, p.line_no, p.chunk_no, q.uuid, CAST(replace(split_part(p.file_path, '/s', 2), '.jsonl', '') AS BIGINT) AS conv
  FROM p JOIN parsed q ON q.file_path = p.file_path AND q.line_no = p.line_no JOIN gated g ON g.file_path = p.file_path
), failed AS (
  SELECT file_path, count(DISTINCT chunk_no) AS chunks, min(chunk_no) FILTER (WHERE (conv + chunk_no) % 4 = 3) AS first_failed FROM chunks GROUP BY file_path
), sent1 AS (
  SELECT chunks.* FROM chunks JOIN failed USING (file_path) WHERE first_failed IS NULL OR chunk_no < first_failed
), fresh1 AS (SELECT * FROM sent1 QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY file_path, line_no) = 1
), sent2 AS (SELECT chunks.* FROM chunks JOIN failed USING (file_path) WHERE first_failed IS NOT NULL
), fresh2 AS (SELECT * FROM sent2 WHERE uuid NOT IN (SELECT uuid FROM fresh1) QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY file_path, line_no) = 1
), per AS (
  SELECT 1 AS pass, file_path, (SELECT count(*) FROM sent1 s WHERE s.file_path = f.file_path) AS sent, (SELECT count(*) FROM fresh1 s WHERE s.file_path = f.file_path) AS inserted, chunks, first_failed FROM failed f
  UNION ALL
  SELECT 2, file_path, (SELECT count(*) FROM sent2 s WHERE s.file_path = f.file_path), (SELECT count(*) FROM fresh2 s WHERE s.file_path = f.file_path), chunks, NULL FROM failed f WHERE first_failed IS NOT NULL)
SELECT pass, file_path, first_failed IS NULL AS ok, chunks, CAST(inserted AS BIGINT) AS inserted, CAST(sent - inserted AS BIGINT) AS deduped, first_failed,
  CASE WHEN first_failed IS NOT NULL THEN concat('transient failure, status 503, chunk ', first_failed) END AS error, false AS duplicate
FROM per"""
)
def passes_with_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes over the files of ``lines``: in the first one the receiver refuses some requests, in the second one none."""
    root, at = _lines_written(spark, sf_dir), work_folder(spark, "passes")
    tables, repos = Tables(f"{at}/store", f"{at}/cursors", f"{at}/work", buckets=4), fixture(spark, sf_dir, "repos")

    def refusing(path: str, chunk: int, body: str) -> int:
        return 503 if (int(path.rsplit("/s", 1)[1].removesuffix(".jsonl")) + chunk) % 4 == 3 else 200

    limits = Limits(1 << 40, REQUEST, FIRST, SECOND, COUNT, attempts=1)
    runs = [ingest(spark, list_transcripts(spark, root), repos, tables, sender=Sender(send=s), limits=limits) for s in (refusing, None)]
    first, second = (r.files.withColumn("pass", F.lit(k + 1)) for k, r in enumerate(runs))
    return first.unionByName(second).withColumn("file_path", _under(root))


@query(f"WITH {GATED} SELECT session_id, record_count, skipped_lines, project_path FROM gated")
def dry_pass_over_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a dry pass over the files of ``lines`` says: listed, read from their cursors, gated, and nothing sent."""
    root, at = _lines_written(spark, sf_dir), work_folder(spark, "dry")
    tables = Tables(f"{at}/store", f"{at}/cursors", f"{at}/work")
    return ingest(spark, list_transcripts(spark, root), fixture(spark, sf_dir, "repos"), tables, dry=True).files
