"""Derived input tables: one SQL text for each, which Spark and DuckDB run alike over the given tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_PATH = "concat('/t/projects/-home-u', CAST(conv_id % 5 AS STRING), '-src-app', CAST(conv_id % 3 AS STRING), '/s', CAST(conv_id AS STRING), '.jsonl')"


def escaped(c: str) -> str:
    """A JSON string's content: the texts hold no control characters but newline and tab."""
    return f"replace(replace(replace(replace({c}, chr(92), concat(chr(92), chr(92))), '\"', concat(chr(92), '\"')), chr(10), concat(chr(92), 'n')), chr(9), concat(chr(92), 't'))"


def nested(text: str) -> str:
    """A nested record around a text (an SQL expression)."""
    return (
        "concat('{\"uuid\":\"', md5(CAST(doc_id AS STRING)), '\",\"n\":', CAST(doc_id AS STRING), ',\"message\":{\"content\":[{\"type\":\"text\",\"text\":\"', "
        + escaped(text)
        + ", '\"},{\"type\":\"tag\",\"text\":\"', lang, '\"}],\"keep\":null}}')"
    )


FIXTURES: dict[str, str] = {
    "lines": f"""
SELECT {_PATH} AS file_path,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS line_no,
  CASE WHEN (conv_id * 7 + turn) % 11 = 0 THEN ''
       WHEN (conv_id * 5 + turn) % 13 = 0 THEN '{{"uuid": broken'
       ELSE concat('{{"uuid":"', md5(concat(CAST(conv_id % 60 AS STRING), '-', CAST(turn AS STRING))), '","role":"', role, '"',
         CASE WHEN conv_id % 4 <> 0 AND turn % 3 = 1 THEN concat(',"cwd":"/home/u', CAST(conv_id % 5 AS STRING), '/src/app-', CAST(turn % 2 AS STRING), '"') ELSE '' END,
         CASE WHEN turn % 4 = 2 THEN concat(',"gitBranch":"b', CAST(turn AS STRING), '"') ELSE '' END,
         ',"text":"', {escaped("text")}, '"}}') END AS raw
FROM conversations""",
    "doc_files": """
SELECT concat('/t/docs/-srv-', source, '/d', CAST(doc_id AS STRING), '.jsonl') AS file_path,
  CASE WHEN doc_id % 3 = 0 THEN concat(text, chr(10)) ELSE text END AS content
FROM documents""",
    "nested_records": f"""
SELECT concat('/t/nested/-srv-', source, '/n.jsonl') AS file_path,
  CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS line_no,
  {nested("text")} AS raw
FROM documents""",
    "repos": """
SELECT concat('/home/u', CAST(u AS STRING), '/src/', app) AS project_path,
  CASE WHEN (u + k) % 4 = 0 THEN NULL WHEN (u + k) % 4 = 1 THEN '  ' ELSE concat(' git@host:team/', app, '.git ') END AS remote,
  CASE WHEN k = 2 THEN NULL ELSE 'main' END AS branch
FROM (SELECT DISTINCT CAST(conv_id % 5 AS INT) AS u FROM conversations) a
CROSS JOIN (VALUES (0, 'app-0'), (1, 'app-1'), (2, 'app0'), (3, 'app1'), (4, 'app2')) b(k, app)
WHERE NOT (u = 3 AND k = 1)""",
    "cursors": """
SELECT file_path,
  CASE WHEN k % 7 = 0 THEN bytes + 100 ELSE CAST(bit_length(concat(first_line, chr(10))) / 8 AS BIGINT) END AS bytes_uploaded,
  CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(1 AS BIGINT) END AS lines_uploaded,
  md5(first_line) AS sha256_of_last_upload,
  '2024-01-01T00:00:00.000Z' AS last_run_at
FROM (SELECT file_path, CAST(row_number() OVER (PARTITION BY source ORDER BY file_path) AS BIGINT) AS k,
        CAST(bit_length(content) / 8 AS BIGINT) AS bytes, split_part(content, chr(10), 1) AS first_line
      FROM (SELECT file_path, content, split_part(file_path, '/', 4) AS source FROM doc_files) y) x
WHERE k % 3 <> 0""",
    "outcomes": f"""
SELECT {_PATH} AS file_path, CAST(turn AS BIGINT) AS chunk_no,
  CAST(CASE WHEN (conv_id * 3 + turn) % 17 = 0 THEN 413 WHEN (conv_id + turn) % 19 = 0 THEN 503 ELSE 200 END AS INT) AS status,
  CAST(turn % 3 AS BIGINT) AS inserted, CAST(turn % 2 AS BIGINT) AS deduped
FROM conversations""",
    "attempts": """
SELECT CAST(event_id - event_id % 4 AS BIGINT) AS request_id, CAST(event_id % 4 + 1 AS BIGINT) AS attempt,
  CAST(CASE WHEN event_type = 'error' THEN NULL WHEN user_id % 5 = 0 THEN 429 WHEN user_id % 5 = 1 THEN 401
            WHEN user_id % 5 = 2 THEN 500 ELSE 200 END AS INT) AS status
FROM events""",
    "machines": """
SELECT md5(s_name) AS install_id, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE concat('host', CAST(s_suppkey AS STRING)) END AS hostname, 'linux' AS os
FROM supplier""",
    "accounts": """
SELECT CASE WHEN c_custkey % 5 = 0 THEN concat('ov', CAST(c_custkey AS STRING)) WHEN c_custkey % 5 = 1 THEN '' ELSE NULL END AS override_id,
  CASE WHEN c_custkey % 3 = 0 THEN md5(c_name) WHEN c_custkey % 3 = 1 THEN '' ELSE NULL END AS account_uuid,
  CASE WHEN c_custkey % 2 = 0 THEN concat('id', CAST(c_custkey AS STRING)) ELSE NULL END AS user_id,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('u', CAST(c_custkey AS STRING), '@example.com') END AS email,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS username
FROM customer""",
}
TABLES = ("conversations", "documents", "events", "supplier", "customer")


def with_fixtures(sql: str) -> str:
    """The SQL with the fixtures it names, and theirs, as common table expressions."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in FIXTURES:
            if re.search(rf"\b{name}\b", text) and name not in need:
                add(FIXTURES[name])
                need.append(name)

    add(sql)
    ctes = ", ".join(f"{n} AS ({FIXTURES[n]})" for n in need)
    sql = sql.strip()
    if not need:
        return sql
    if sql.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {sql.removeprefix('WITH RECURSIVE ')}"
    return f"WITH {ctes}, {sql.removeprefix('WITH ')}" if sql.startswith("WITH ") else f"WITH {ctes} {sql}"


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table over the Parquet tables of a folder."""
    sql = with_fixtures(f"SELECT * FROM {name}")
    found = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\bFROM {t}\b", sql)}
    for t in found:
        sql = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(_braces(sql, found), **found)


def _braces(sql: str, found: dict[str, DataFrame]) -> str:
    """Braces of the JSON text doubled, but those that name a table."""
    out = sql.replace("{", "{{").replace("}", "}}")
    for t in found:
        out = out.replace(f"{{{{{t}}}}}", f"{{{t}}}")
    return out
