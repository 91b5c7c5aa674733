"""Settings that the jobs rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Transcripts are many small files. At Spark's 4 MB for opening one, a task reads 32 of them, however small; at this, some thousand.
OPEN_COST = 128 << 10
SETTINGS = {"spark.sql.variant.allowDuplicateKeys": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.files.openCostInBytes": str(OPEN_COST)}


def prepare_session(spark: SparkSession) -> SparkSession:
    """Set what record parsing needs (of duplicate keys the last one wins), and how small files are dealt to tasks."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def check_session(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.variant.allowDuplicateKeys") != "true":
        raise ValueError("call prepare_session(spark) first: spark.sql.variant.allowDuplicateKeys must be true")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share; under a temporary one where that is unset and all is one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
