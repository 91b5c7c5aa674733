"""Sending requests so that nothing of a file goes out behind what failed."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cursors import classify_outcomes
from ..sources.store import Keep

ATTEMPTS = "file_path string, chunk_no long, attempt int, status int"
BY = ["file_path", "chunk_no"]
#: Waits between attempts, in seconds: this, doubled each time.
FIRST_WAIT = 0.5


@dataclass
class Sender:
    """Who sends, and how; without ``send`` and ``deliver`` every request counts as accepted.

    ``send(file_path, chunk_no, body)`` gives a status (None: no answer) and runs in tasks: a file's requests one after the other, files
    side by side. ``deliver`` takes requests (file_path, chunk_no, body) as a DataFrame and gives attempts (file_path, chunk_no, attempt, status); it
    is called in rounds, with the next request of each file that has not failed.
    """

    machine: dict[str, str | None] = field(default_factory=lambda: {"fingerprint": "unknown"})
    account: dict[str, str | None] = field(default_factory=lambda: {"vendorAccountId": "username:unknown"})
    deliver: Callable[[DataFrame], DataFrame] | None = None
    send: Callable[[str, int, str], int | None] | None = None


def final(status: int | None) -> bool:
    """Whether another attempt is of no use."""
    return status is not None and (200 <= status < 300 or (400 <= status < 500 and status != 429))


def _sending(send: Callable[[str, int, str], int | None], most: int, first_wait: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failed = None
        for b in batches:
            out = []
            for k in range(b.num_rows):
                path, chunk = b.column("file_path")[k].as_py(), b.column("chunk_no")[k].as_py()
                if path == failed:
                    continue
                for attempt in range(1, most + 1):
                    status = send(path, chunk, b.column("body")[k].as_py())
                    out.append((path, chunk, attempt, status))
                    if final(status):
                        break
                    if attempt < most:
                        time.sleep(first_wait * 2 ** (attempt - 1))
                if status is None or not 200 <= status < 300:
                    failed = path
            names = [c.split()[0] for c in ATTEMPTS.split(", ")]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    return run


def _round(front: DataFrame, deliver: Callable[[DataFrame], DataFrame], most: int, keep: Keep, name: str) -> DataFrame:
    """Attempts at the requests of a round: transient failures are tried again, up to ``most`` attempts."""
    every, waiting, before = None, front, 0
    while True:
        numbered = (F.col("attempt") + before).cast("int").alias("attempt")
        # a function: what was kept before is not sent again
        got = keep(lambda w=waiting, n=numbered: deliver(w).select("file_path", "chunk_no", n, F.col("status").cast("int").alias("status")), f"{name}-{before}")
        every = got if every is None else every.unionByName(got)
        before = got.agg(F.max("attempt")).first()[0] or most  # no attempt at all: not sent
        again = classify_outcomes(every, most, BY).where("outcome = 'transient'").select(*BY)
        waiting = front.join(again, BY, "left_semi")
        if before >= most or waiting.isEmpty():
            return every


def deliver_requests(requests: DataFrame, sender: Sender, attempts: int, keep: Keep, first_wait: float = FIRST_WAIT) -> DataFrame:
    """The attempts made (``ATTEMPTS``): of each file its requests in order, none behind one that failed.

    With ``send``, a task that is lost sends its files' requests again; with ``deliver``, finished rounds are kept and never repeated.
    """
    if sender.send:
        ordered = requests.repartition("file_path").sortWithinPartitions("file_path", "chunk_no")
        return keep(ordered.mapInArrow(_sending(sender.send, attempts, first_wait), ATTEMPTS), "attempts")
    if not sender.deliver:
        return keep(requests.select(*BY, F.lit(1).alias("attempt"), F.lit(200).alias("status")), "attempts")
    made, going, chunk = None, None, 0
    while True:
        front = requests.where(F.col("chunk_no") == chunk)
        front = front if going is None else front.join(going, "file_path", "left_semi")
        if front.isEmpty():
            break
        got = _round(front, sender.deliver, attempts, keep, f"attempts-{chunk}")
        made = got if made is None else made.unionByName(got)
        going = keep(classify_outcomes(got, attempts, BY).where("outcome = 'ok'").select("file_path"), f"going-{chunk}")
        chunk += 1
    return made if made is not None else requests.select(*BY, F.lit(1).alias("attempt"), F.lit(200).alias("status"))
