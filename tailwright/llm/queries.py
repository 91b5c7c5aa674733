"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, fold, table
from .context_mixing import score_documents
from .decontamination import contamination, report
from .embedding_dedup import dedup_embeddings
from .minhash_dedup import dedup_documents
from .mixing import mix_documents
from .oracles import DECONTAMINATION_SQL, PHRASES_SQL, part_codes_sql
from .packing import pack_documents
from .part_codes import code_vectors
from .phrases import mine_phrases
from .quality_classifier import fit as fit_quality
from .quality_classifier import score_quality
from .quality_rules import BOILERPLATE, quality_rules
from .token_files import read_tokens, write_tokens
from .tokens import default_path
from .toxicity import fit as fit_toxicity
from .toxicity import score_toxicity
from .warc import derive, read_parts, response_records, responses_of_pages, write_warc


def op1_line_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), cleaned=False)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_path("word_bpe_49k.json"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), f"{ws.path}/ids", default_path("byte_bpe_50k.json"), ws=ws)
    return read_tokens(spark, f"{ws.path}/ids")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        F.coalesce(fold() == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "threshold",
        "rejected",
    )


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_documents(table(spark, sf_dir, "documents"))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of all pages go to WARC files and are read back; what derives from them goes to WARC files, and their records are returned as read."""
    ws = Workspace(spark, "warc")
    sources = responses_of_pages(table(spark, sf_dir, "pages"))
    written = ws.save(write_warc(response_records(sources), f"{ws.path}/responses"), "written")
    derived = derive(read_parts(written, f"{ws.path}/responses"))
    parts = ws.save(write_warc(derived, f"{ws.path}/derivatives"), "parts")
    read = read_parts(parts, f"{ws.path}/derivatives")
    return read.select(
        "record_id", "record_type", "refers_to", "target_uri", "date",
        F.octet_length("block").cast("long").alias("content_length"), F.crc32("block").alias("block_crc32"), F.sha1("block").alias("block_sha1"),
    )


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_embeddings(table(spark, sf_dir, "embeddings"))


def op11_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_vectors(table(spark, sf_dir, "embeddings"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_quality_rules": op1_line_quality_rules,
    "op2_mixing": op2_mixing,
    "op3_packing": op3_packing,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_token_files": op5_token_files,
    "op6_toxicity": op6_toxicity,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_warc_derivatives": op8_warc_derivatives,
    "op9_context_mixing": op9_context_mixing,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_part_codes": op11_part_codes,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_decontamination": op13_decontamination,
}

#: Line rules in the order that the operator tries them; limits are those of ``Rules``.
OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, ord, line, string_split_regex(line, '[\x20\x09-\x0D]+') AS raw
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ord FROM documents)
), own AS (
  SELECT doc_id, ord, line, list_filter(raw, lambda w: w <> '') AS words FROM lines
), marked AS (
  SELECT doc_id, words, len(words) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY ord) > 1 AS earlier,
    length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols,
    len(list_filter(words, lambda w: w IN ('|', '>', '<', '/', '-', '*', '·', '•', '»', '›'))) AS separators,
    CASE WHEN contains(line, '!!') OR contains(line, '??')
         THEN len(list_filter(words, lambda w: regexp_matches(w, '(!!|\?\?|\*\*|\$\$|%%|##|&&)$'))) ELSE 0 END AS shouts,
    regexp_matches(words[-1], '[.!?:;"'')\]}…”’»。！？]$') AS ended,
    regexp_matches(lower(line), 'PHRASES') AS phrase
  FROM own WHERE len(words) > 0
), failed AS (
  SELECT doc_id, n, earlier, CASE
      WHEN n >= 2 AND 100 * separators > 20 * n THEN 'n'
      WHEN 100 * symbols > 30 * n OR 100 * shouts > 30 * n OR (n < 4 AND NOT ended) THEN 'p'
      WHEN earlier OR phrase THEN 'b' END AS why
  FROM marked
), removed AS (
  SELECT doc_id, count(*) FILTER (earlier) AS n_dup_lines, coalesce(sum(n) FILTER (why IS NOT NULL), 0) AS lost_words,
    count(*) FILTER (why = 'p') AS punctuation_lines, count(*) FILTER (why = 'n') AS navigation_lines,
    count(*) FILTER (why = 'b') AS boilerplate_lines
  FROM failed GROUP BY doc_id
), texts AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS times
  FROM (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i,
               unnest(list_transform(range(1, len(words) - 1), lambda i: list_aggregate(words[i:i+2], 'string_agg', ' '))) AS w
        FROM texts WHERE len(words) >= 3)
), repeated AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words
  FROM windows, (VALUES (0), (1), (2)) v(j) WHERE times > 1 GROUP BY doc_id
), base AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(lost_words, 0) AS BIGINT) AS lost_words, CAST(coalesce(punctuation_lines, 0) AS BIGINT) AS punctuation_lines,
    CAST(coalesce(navigation_lines, 0) AS BIGINT) AS navigation_lines, CAST(coalesce(boilerplate_lines, 0) AS BIGINT) AS boilerplate_lines
  FROM texts LEFT JOIN removed USING (doc_id) LEFT JOIN repeated USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_words <= 30 * n_words AS kept
FROM base
""".replace("PHRASES", "|".join(BOILERPLATE))

ORACLES: dict[str, str] = {
    "op1_line_quality_rules": OP1_SQL,
    "op11_part_codes": part_codes_sql(),
    "op12_phrase_mining": PHRASES_SQL,
    "op13_decontamination": DECONTAMINATION_SQL,
}
