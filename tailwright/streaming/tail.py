"""A stream of the complete lines that are appended to transcript files."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.files import behind_last_newline, place, read_range, store_settings, walk

#: With the bytes of a range, or with its place only.
SCHEMAS = {"true": "file_path string, start long, content binary", "false": "file_path string, start long, end long"}
#: Bytes of one file that one partition takes at most, in whole lines; longer lines are taken whole.
RANGE_BYTES = 64 << 20
#: Bytes of short ranges that one task reads.
TASK_BYTES = 8 << 20
#: Entries of the log from one whole list of files to the next.
ENTRIES = 100


class Range(NamedTuple):
    path: str
    start: int
    end: int


class Ranges(InputPartition):
    """What one task reads: a long range, or many short ones."""

    def __init__(self, ranges: list[Range]):
        self.ranges = ranges


def together(ranges: Iterator[Range], most: int) -> Iterator[Ranges]:
    """Ranges in a row, so many in one task that they have about ``most`` bytes."""
    held: list[Range] = []
    size = 0
    for r in ranges:
        if held and size + r.end - r.start > most:
            yield Ranges(held)
            held, size = [], 0
        held.append(r)
        size += r.end - r.start
    if held:
        yield Ranges(held)


def cut(path: str, start: int, end: int, most: int) -> Iterator[Range]:
    for at in range(start, end, most):
        yield Range(path, at, min(at + most, end))


class Log:
    """What each offset changed, one small file for each: sizes of files that grew or are gone. An offset itself is a number.

    Every so many entries the sizes of all files are kept beside it, and entries before it go once their offset is
    committed, so the log is bounded by the files there are and what changed of late.
    """

    def __init__(self, path: str, settings: dict[str, str]):
        self.store, self.path = place(path, settings)
        self.store.create_dir(self.path, recursive=True)
        self.at, self.sizes = 0, {}
        names = self._names()
        whole = max((n for n in names if n.endswith(".all")), default=None)
        if whole:
            self.at, self.sizes = int(whole.split(".")[0]), self._read(whole)
        for n in names:
            if n.endswith(".log") and int(n.split(".")[0]) > self.at:
                self._apply(self._read(n))
                self.at = int(n.split(".")[0])

    def _names(self) -> list[str]:
        found = self.store.get_file_info(fs.FileSelector(self.path))
        return sorted(x.base_name for x in found if x.base_name.endswith((".log", ".all")))

    def _read(self, name: str) -> dict:
        with self.store.open_input_file(f"{self.path}/{name}") as f:
            return json.loads(f.read())

    def _write(self, name: str, value: dict) -> None:
        with self.store.open_output_stream(f"{self.path}/{name}.tmp") as f:
            f.write(json.dumps(value).encode())
        self.store.move(f"{self.path}/{name}.tmp", f"{self.path}/{name}")

    def _apply(self, changes: dict[str, list]) -> None:
        for path, (_, to) in changes.items():
            if to is None:
                self.sizes.pop(path, None)
            else:
                self.sizes[path] = to

    def add(self, changes: dict[str, list]) -> None:
        self.at += 1
        self._write(f"{self.at:012d}.log", changes)
        self._apply(changes)
        if self.at % ENTRIES == 0:
            self._write(f"{self.at:012d}.all", self.sizes)

    def between(self, start: int, end: int) -> dict[str, tuple[int, int]]:
        """Of each file that grew: from where, and to where."""
        out: dict[str, tuple[int, int]] = {}
        for k in range(start + 1, end + 1):
            for path, (low, high) in self._read(f"{k:012d}.log").items():
                if high is None:
                    out.pop(path, None)
                else:
                    out[path] = (min(low, out.get(path, (low, 0))[0]), high)
        return out

    def forget(self, committed: int) -> None:
        """Drop what lies before the last whole list that is not ahead of a committed offset."""
        names = self._names()
        whole = max((n for n in names if n.endswith(".all") and int(n.split(".")[0]) <= committed), default=None)
        for n in names:
            if whole and n.split(".")[0] <= whole.split(".")[0] and n != whole:
                self.store.delete_file(f"{self.path}/{n}")


class TailReader(DataSourceStreamReader):
    """Offsets are numbers of entries in a log; entries have sizes. Tasks find the newlines, so a line still being written waits for its end.

    A range [a, b) stands for the lines whose newline lies in it: from behind the last newline before a to behind the last one before b. The driver lists, and opens no file.
    A restart reads the log, and goes on from it. While the file ``held`` exists, every look gives a new offset, with or without new bytes.
    """

    def __init__(self, root: str, most: int, log: str, held: str | None, content: bool, settings: dict[str, str]):
        self.root, self.most, self.where, self.held, self.content, self.settings = root, most, log, held, content, settings
        self._log: Log | None = None

    @property
    def log(self) -> Log:
        if self._log is None:
            self._log = Log(self.where, self.settings)
        return self._log

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_log": None}

    def initialOffset(self) -> dict:
        return {"at": 0}

    def _waiting(self) -> bool:
        if not self.held:
            return False
        store, path = place(self.held, self.settings)
        return store.get_file_info(path).type == fs.FileType.File

    def latestOffset(self) -> dict:
        before, changes, found = self.log.sizes, {}, set()
        for path, size in walk(self.root, ".jsonl", self.settings):
            found.add(path)
            low = before.get(path, 0)
            if size != low:
                changes[path] = [low if size > low else 0, size]  # smaller: another file under the same name
        changes |= {path: [0, None] for path in before.keys() - found}
        if changes or self._waiting():
            self.log.add(changes)
        return {"at": self.log.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        grown = sorted(self.log.between(start["at"], end["at"]).items())
        ranges = (r for path, (low, high) in grown for r in cut(path, low, high, self.most if self.content else 1 << 62))
        return list(together(ranges, min(self.most, TASK_BYTES)))

    def commit(self, end: dict) -> None:
        self.log.forget(end["at"])

    def read(self, partition: Ranges) -> Iterator[tuple]:
        for r in partition.ranges:
            try:
                start, end = (behind_last_newline(r.path, at, self.settings) for at in (r.start, r.end))
                if start < end:
                    yield r.path, start, b"".join(read_range(r.path, start, end, self.settings)) if self.content else end
            except FileNotFoundError:
                pass  # gone since it was listed


class TranscriptTail(DataSource):
    """``spark.readStream.format("transcript_tail")``: ``path`` and ``log`` are folders that driver and executors reach."""

    @classmethod
    def name(cls) -> str:
        return "transcript_tail"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("content", "true")]

    def streamReader(self, schema) -> TailReader:
        o = self.options
        settings = json.loads(o.get("settings", "{}"))
        return TailReader(o["path"], int(o.get("rangebytes", RANGE_BYTES)), o["log"], o.get("held"), o.get("content", "true") == "true", settings)


def tail(spark: SparkSession, root: str, log: str, range_bytes: int = RANGE_BYTES, content: bool = True, held: str | None = None) -> DataFrame:
    """The stream of ranges of whole lines under ``root``; ``log`` belongs to one checkpoint, like its offsets."""
    spark.dataSource.register(TranscriptTail)
    options = {"path": root, "log": log, "rangebytes": str(range_bytes), "content": str(content).lower(), "settings": json.dumps(store_settings(spark))}
    return spark.readStream.format("transcript_tail").options(**options | ({"held": held} if held else {})).load()
