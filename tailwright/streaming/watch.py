"""Running passes again and again over growing files."""

from __future__ import annotations

import logging
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.session import prepare_session
from ..plans.delivery import Sender
from ..plans.incremental import Limits, Run, Tables, ingest
from ..sources.store import read_or_empty
from ..sources.transcripts import drop_folder, read_text, write_text
from .tail import RANGE_BYTES, tail

SECONDS = 60
HELD = "file_path string, length long"


def pass_over(spark: SparkSession, grown: DataFrame, repos: DataFrame, tables: Tables, held: str, key: str, project: str | None = None, sender: Sender | None = None, limits: Limits | None = None) -> Run:
    """A pass over files that grew, up to where they grew (file_path, end), and over those that an earlier batch could not deliver.

    What is read begins at the files' cursors, as in any pass. Files that fail are held for the next batch. The batch's ``key`` names its work: a batch
    that is replayed goes on from its finished steps, and if it was committed does nothing.
    """
    table = f"{held}.d"
    waiting = read_or_empty(spark, f"{table}/{told}", HELD) if (told := read_text(spark, held)) else spark.createDataFrame([], HELD)
    files = grown.select("file_path", F.col("end").alias("length")).unionByName(waiting).groupBy("file_path").agg(F.max("length").alias("length"))
    run = ingest(spark, files, repos, tables, project, sender=sender, limits=limits, key=key)
    failed = run.files.where("not ok").select("file_path").join(files, "file_path")
    if failed.isEmpty():
        write_text(spark, held, None)
    else:
        failed.select("file_path", "length").write.mode("overwrite").parquet(f"{table}/{key}")
        write_text(spark, held, key)
    if told and told != key:
        drop_folder(spark, f"{table}/{told}")
    return run


def watch(
    spark: SparkSession, root: str, repos: Callable[[], DataFrame], tables: Tables, checkpoint: str, project: str | None = None, seconds: int | None = SECONDS,
    range_bytes: int = RANGE_BYTES, sender: Sender | None = None, limits: Limits | None = None, told: Callable[[Run], None] | None = None,
) -> StreamingQuery:
    """Start the stream: every ``seconds``, or (None) once over what there is, a pass over the files that grew.

    The checkpoint moves only after a pass is committed; a batch that failed is taken up again. Files whose requests failed are tried again by
    the next batch, which comes even if nothing grew. ``repos`` is called for each batch, so that new remotes count; ``told`` gets each pass' results.
    """
    prepare_session(spark)
    held, own = f"{checkpoint}/held", f"{checkpoint}/name"
    name = read_text(spark, own)
    if not name:
        write_text(spark, own, name := uuid.uuid4().hex[:12])

    def each(ranges: DataFrame, batch: int) -> None:
        run = pass_over(ranges.sparkSession, ranges, repos(), tables, held, f"watch-{name}-{batch}", project, sender, limits)
        if told:
            told(run)

    stream = tail(spark, root, f"{checkpoint}/tail", range_bytes, content=False, held=held)
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint}/stream")
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def keep_watching(start: Callable[[], StreamingQuery], stop: threading.Event, seconds: float = SECONDS) -> int:
    """Run the stream that ``start`` starts until ``stop`` is set; returns how often it failed.

    A failed stream is logged and, ``seconds`` later, started again from its checkpoint: the batch that failed
    is taken up again, so nothing is lost, and what part of it was stored is known and not stored twice. A stream that ends by itself
    (one-shot) is started again, too.
    """
    failures = 0
    while not stop.is_set():
        query = None
        try:
            query = start()
            while not stop.is_set() and not query.awaitTermination(1):
                pass
        except Exception:
            failures += 1
            logging.getLogger(__name__).exception("the stream failed; it starts again in %s seconds", seconds)
        finally:
            if query is not None and query.isActive:
                query.stop()
        stop.wait(seconds)
    return failures
