"""Reading files in splits, stores by scheme, cursors as deltas, the store's sketches, the log of the tail."""

import hashlib
import json
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailwright.functions.session import prepare_session
from tailwright.sources import files as stores
from tailwright.sources.files import behind_last_newline, place, reachable, walk
from tailwright.sources.store import append_records, known_keys, may_hold, sketch, sketches, stored_records
from tailwright.sources.transcripts import add_cursors, list_folders, load_cursors, read_lines, read_transcripts
from tailwright.streaming.tail import ENTRIES, Log, TailReader

RANGES = "file_path string, start long, end long, lines_before long"


def _content(seed, lines=200):
    rng = random.Random(seed)
    out = b"".join(bytes(rng.choice(b"ab\xc3\xa9\xff ") for _ in range(rng.choice([0, 0, 1, 5, 40, 300]))) + b"\n" for _ in range(lines))
    return out + b"unfinished"


def _expected(content, start, before, path):
    body = content[start:]
    used = body[: body.rfind(b"\n") + 1]
    rows, at = [], start
    for no, x in enumerate(used.split(b"\n")[:-1]):
        rows.append((path, start, before, no, at, len(x), x.decode("utf-8", "replace"), None))
        at += len(x) + 1
    return [*rows, (path, start, before, len(rows), at, None, None, hashlib.sha256(used).hexdigest())] if used else []


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 1 << 20])
def test_splits_of_a_file_give_the_rows_of_one(spark, tmp_path, split):
    ranges, want = [], []
    for k, (lines, start) in enumerate([(60, 0), (40, 333), (1, 0), (0, 0)]):
        path = f"{tmp_path}/f{k}.jsonl"
        content = _content(k, lines) if lines else b"no line yet"
        if lines == 40:
            content = content[:333].rpartition(b"\n")[0] + b"\n" + content[333:] if b"\n" in content[:333] else content
            start = content[:334].rfind(b"\n") + 1
        Path(path).write_bytes(content)
        ranges.append((path, start, len(content), k))
        want += _expected(content, start, k, path)
    if split < 60:  # every byte a split: only a small file
        ranges, want = ranges[2:], [r for r in want if r[0] in (ranges[2][0], ranges[3][0])]
    got = read_lines(spark.createDataFrame([*ranges, (f"{tmp_path}/gone", 0, 50, 0)], RANGES), split_bytes=split)
    assert _rows(got) == sorted(want, key=repr)


def test_a_store_that_only_spark_reads(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.only.link./in", f"file://{tmp_path}")
    content = _content(9, 30)
    Path(f"{tmp_path}/f.jsonl").write_bytes(content)
    assert not reachable("viewfs://only/in/f.jsonl")
    path, start = "viewfs://only/in/f.jsonl", content[:100].rfind(b"\n") + 1
    got = read_lines(spark.createDataFrame([(path, start, len(content), 3), (f"{tmp_path}/f.jsonl", 0, len(content), 0)], RANGES))
    assert _rows(got) == sorted(_expected(content, start, 3, path) + _expected(content, 0, 0, f"{tmp_path}/f.jsonl"), key=repr)


def test_schemes_with_the_settings_of_spark(spark, monkeypatch):
    given = {}

    class Store:
        def __init__(self, **kw):
            given.update(kw)

    monkeypatch.setattr(stores.fs, "S3FileSystem", Store)
    monkeypatch.setattr(stores.fs, "AzureFileSystem", Store)
    monkeypatch.setattr(stores, "_OPEN", {})
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.s3a.access.key", "k")
    conf.set("fs.s3a.bucket.b.secret.key", "s")
    conf.set("fs.azure.account.key.acc.blob.core.windows.net", "z")
    settings = stores.store_settings(spark)
    for key in ("fs.s3a.access.key", "fs.s3a.bucket.b.secret.key", "fs.azure.account.key.acc.blob.core.windows.net"):
        conf.unset(key)
    assert place("s3a://b/x/y.jsonl", settings)[1] == "b/x/y.jsonl" and given["access_key"] == "k" and given["secret_key"] == "s"
    assert place("wasbs://c@acc.blob.core.windows.net/x/y", settings)[1] == "c/x/y" and given["account_key"] == "z" and given["account_name"] == "acc"
    assert place("file:/a/b")[1] == place("file:///a/b")[1] == place("/a/b")[1] == "/a/b"


def _cursor(path, n):
    return (path, n, n, "s", "t")


def test_moved_cursors_are_deltas(spark, tmp_path):
    schema, at = "file_path string, bytes_uploaded long, lines_uploaded long, sha256_of_last_upload string, last_run_at string", f"{tmp_path}/c"
    want = {f"f{k}": 1 for k in range(50)}
    add_cursors(spark.createDataFrame([_cursor(f, n) for f, n in want.items()], schema), at)
    for step in range(5):
        moved = {f"f{step}": step + 2, f"g{step}": 1}
        want |= moved
        add_cursors(spark.createDataFrame([_cursor(f, n) for f, n in moved.items()], schema), at, most=3)
        names = sorted(list_folders(spark, at))
        assert {r.file_path: r.bytes_uploaded for r in load_cursors(spark, at).collect()} == want
        if step == 0:
            assert spark.read.parquet(f"{at}/{names[-1]}").count() == 2  # what was moved, not what there is
    assert any(not n.endswith("-delta") for n in names[1:])  # deltas became one table


RECORD = "record_key string, uuid string, session_id string, project_path string, file_path string, byte_start long, record string"


def _keep(tmp):
    def keep(df, name):
        df.write.mode("overwrite").parquet(f"{tmp}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{tmp}/{name}")

    return keep


def test_only_files_that_may_hold_a_key_are_read_and_none_is_shuffled(spark, tmp_path):
    at, keep = f"{tmp_path}/store", _keep(tmp_path / "k")
    record = lambda ks: spark.createDataFrame([(k, k, "s", "p", "f", 0, "{}") for k in ks], RECORD)
    keys = lambda ks: spark.createDataFrame([(k,) for k in ks], "record_key string")
    assert known_keys(keys(["a"]), at, keep).count() == 0
    append_records(record([f"k{i}" for i in range(400)]), at, 400, 8)
    append_records(record([f"m{i}" for i in range(400)]), at, 400, 8)
    found = known_keys(keys(["k7", "m9", "x1", "x2"]), at, keep, buckets=99)  # the store's own number of buckets counts
    assert sorted(r.record_key for r in found.collect()) == ["k7", "m9"]
    whole = sketches(spark, at).count()
    read = {f for f in found.inputFiles() if "/bucket=" in f}
    assert whole >= 16 and 0 < len(read) <= 4
    # from the scan of the store up to the join there is no exchange
    plan = known_keys(keys(["k7"]), at, keep)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-*")) for x in plan]

    def above(k):
        out, d = [], depth[k]
        for i in range(k - 1, -1, -1):
            if depth[i] < d:
                out.append(plan[i])
                d = depth[i]
        return out[: next(i for i, x in enumerate(out) if "BroadcastHashJoin" in x and "LeftSemi" in x)]

    # one scan is the store's, the other one that of the keys that are broadcast
    paths = [above(k) for k, x in enumerate(plan) if "FileScan parquet" in x]
    assert sorted(any("Exchange" in x for x in p) for p in paths) == [False, True]
    assert stored_records(spark, at).count() == 800


def test_sketches_have_all_their_keys():
    rng = np.random.default_rng(1)
    own, other = rng.integers(-(1 << 63), (1 << 63) - 1, (2, 20_000))
    assert may_hold(sketch(own), own).all() and may_hold(sketch(own), other).mean() < 0.02
    assert not may_hold(sketch(own[:0]), own).any()


def _reader(tmp, content=True, held=None):
    return TailReader(f"{tmp}/in", 64, f"{tmp}/log", held, content, {})


def _read(reader, start, end):
    return sorted(x for p in reader.partitions(start, end) for x in reader.read(p))


def test_tail_offsets_are_numbers_and_the_log_is_bounded(tmp_path):
    (tmp_path / "in/d").mkdir(parents=True)
    a, b = tmp_path / "in/d/a.jsonl", tmp_path / "in/b.jsonl"
    a.write_bytes(b"one\ntw")
    reader = _reader(tmp_path)
    first = reader.latestOffset()
    assert first == {"at": 1} == reader.latestOffset()
    assert _read(reader, {"at": 0}, first) == [(str(a), 0, b"one\n")]
    a.write_bytes(b"one\ntwo\nthree")
    b.write_bytes(b"x" * 300 + b"\ny\n")
    reader = _reader(tmp_path)  # a restart
    second = reader.latestOffset()
    assert _read(reader, first, second) == [(str(b), 0, b"x" * 300 + b"\n"), (str(b), 301, b"y\n"), (str(a), 4, b"two\n")] or sorted(_read(reader, first, second)) == sorted([(str(b), 0, b"x" * 300 + b"\ny\n"), (str(a), 4, b"two\n")])
    b.unlink()
    third = reader.latestOffset()
    assert third == {"at": 3} and str(b) not in reader.log.sizes
    a.write_bytes(b"new\n")  # another file under the same name
    fourth = reader.latestOffset()
    assert _read(reader, third, fourth) == [(str(a), 0, b"new\n")]
    for k in range(2 * ENTRIES):
        with a.open("ab") as f:
            f.write(b"z\n")
        now = reader.latestOffset()
    reader.commit(now)
    assert len(list((tmp_path / "log").iterdir())) <= ENTRIES + 1
    again = Log(f"{tmp_path}/log", {})
    assert (again.at, again.sizes) == (reader.log.at, reader.log.sizes)
    assert max(len(p.read_text()) for p in (tmp_path / "log").glob("*.log")) < 200


def test_held_files_make_new_offsets(tmp_path):
    (tmp_path / "in").mkdir()
    reader = _reader(tmp_path, False, f"{tmp_path}/held")
    assert reader.latestOffset() == {"at": 0}
    (tmp_path / "held").write_text("x")
    assert reader.latestOffset() == {"at": 1} and reader.latestOffset() == {"at": 2}
    assert reader.partitions({"at": 0}, {"at": 2}) == []


def test_listing_and_newlines(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    for name in ("x.jsonl", "a/y.jsonl", "a/b/z.jsonl", "a/no.txt"):
        (tmp_path / name).write_bytes(b"1\n22\n3")
    assert sorted((p.removeprefix(f"{tmp_path}/"), n) for p, n in walk(str(tmp_path), ".jsonl")) == [("a/b/z.jsonl", 6), ("a/y.jsonl", 6), ("x.jsonl", 6)]
    assert list(walk(f"{tmp_path}/none", ".jsonl")) == []
    assert [behind_last_newline(f"{tmp_path}/x.jsonl", at) for at in range(7)] == [0, 0, 2, 2, 2, 5, 5]


def test_small_files_share_tasks(spark, tmp_path):
    """Files are dealt to tasks by their bytes, not 32 to a task; folders are made where they are missing."""
    prepare_session(spark)
    for i in range(300):
        stores.write_once(f"file://{tmp_path}/in/s{i % 3}/f{i}.jsonl", b"%d\n" % i, "1")
    stores.write_once(f"file://{tmp_path}/in/s0/f0.jsonl", b"again\n", "2")
    files = read_transcripts(spark, f"file://{tmp_path}/in")
    assert files.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism + 1
    got = {Path(r.file_path).name: bytes(r.content) for r in files.collect()}
    assert got == {f"f{i}.jsonl": b"%d\n" % i if i else b"again\n" for i in range(300)}


def test_broken_files_are_not_left_out(spark, tmp_path):
    """A file that breaks off is an error, not one row less."""
    (tmp_path / "a.jsonl").write_bytes(b"1\n")
    (tmp_path / ".a.jsonl.crc").write_bytes(b"crc\0\0\0\2\0wrong")
    with pytest.raises(Exception, match="a.jsonl"):
        read_transcripts(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("root", ["{}", "file://{}/", "file:{}", "viewfs://empties{}"])
def test_files_without_bytes_are_read(spark, tmp_path, root):
    """Spark's readers leave files of no bytes out; hidden ones stay so."""
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.empties.link.{tmp_path}", f"file://{tmp_path}")
    for name in ("x.jsonl", "a/b/e.jsonl", "a/b/f.jsonl", "a/e.txt", "a/_e.jsonl", ".b/e.jsonl", "c/_d/e.jsonl", "c/d=1/e.jsonl", "_k=1/e.jsonl"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1\n" if name.endswith("f.jsonl") else b"")
    got = sorted((r.file_path.rpartition(f"{tmp_path}/")[2], bytes(r.content), r.length) for r in read_transcripts(spark, root.format(tmp_path)).collect())
    assert got == [("_k=1/e.jsonl", b"", 0), ("a/b/e.jsonl", b"", 0), ("a/b/f.jsonl", b"1\n", 2), ("c/d=1/e.jsonl", b"", 0), ("x.jsonl", b"", 0)]
