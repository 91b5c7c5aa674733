"""A training-data pipeline over ``documents``: five stages, each one operator.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run`` writes and reads
again as the next one's ``docs``. Labels only fit the toxicity classifier. All stages but the last return the columns of
documents and ignore others. Rows without id or text, empty and very long texts, repeated rows and empty tables have the
results that each stage states; no stage fails on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailwright.llm.common import Workspace, table
from tailwright.llm.minhash_dedup import dedup_documents
from tailwright.llm.mixing import draw_of, mix_documents
from tailwright.llm.packing import pack_documents
from tailwright.llm.quality_rules import quality_rules
from tailwright.llm.tokens import default_path
from tailwright.llm.toxicity import fit, score_toxicity

#: Similarity of five-word shingle sets, in percent, from which documents are near copies.
NEAR_PERCENT = 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled rows outside the held-out fold, does not reject.

    Each row is judged by its own text, whatever its id; texts without words, null ones included, stay. Repeated rows share their fate.
    """
    model = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, keep=COLUMNS).where(~F.col("rejected")).select(*COLUMNS)


def line_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line rules, with the lines that failed removed, and n_chars of what is left.

    Each row is judged by its own text; null and empty texts have too few words and go.
    """
    kept = quality_rules(docs, keep=COLUMNS).where("kept")
    return kept.withColumn("text", F.col("cleaned_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity of 0.8 or more), that of the least id.

    Rows without id stay: nothing stands for them. Of rows equal in all columns one stays; different rows under the id that
    stays all stay. Texts without words are nobody's copies.
    """
    rows = docs.select(*COLUMNS)
    kept = dedup_documents(rows, percent=NEAR_PERCENT).where("kept").select("doc_id").where("doc_id is not null").distinct()
    out = rows.join(kept, "doc_id", "left_semi").select(*COLUMNS).unionByName(rows.where("doc_id is null"))
    twice = rows.groupBy("doc_id").count().where("count > 1")
    return out if twice.isEmpty() else out.dropDuplicates(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens have the target shares of sources, languages and topics.

    Decisions rest on id and text, and find their rows by both, nulls included: repeated rows stay or go together, and
    texts without words stay.
    """
    kept = mix_documents(docs).where("kept").select(F.col("doc_id").alias("k_id"), F.col("draw").alias("k_draw")).distinct()
    rows = docs.select(*COLUMNS, draw_of().alias("own_draw"))
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("own_draw") == F.col("k_draw"))
    return rows.join(kept, same, "left_semi").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, packed into windows of 2048 ids; null and empty texts are the end id alone."""
    return pack_documents(docs, default_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line_quality_rules", line_quality_rules),
    ("minhash_dedup", minhash_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Training a classifier, signatures, raking and packing are not SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return docs
