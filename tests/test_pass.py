"""End to end: real files, passes, crashes, replays and the stream."""

import json

import pytest

from pyspark.sql import functions as F

from tailwright.plans.delivery import Sender
from tailwright.plans.incremental import Limits, Tables, gated_batches, ingest, run_pass, sweep
from tailwright.sources.transcripts import list_transcripts, load_cursors, new_ranges, read_transcripts, save_cursors
from tailwright.streaming.watch import keep_watching, watch


def _line(uuid, **more):
    return json.dumps({"uuid": uuid, "cwd": "/w/app", **more}).encode() + b"\n"


@pytest.fixture
def tree(tmp_path):
    a, b = tmp_path / "in/-w-app", tmp_path / "in/deep/-w-secret"
    a.mkdir(parents=True)
    b.mkdir(parents=True)
    (a / "s1.jsonl").write_bytes(_line("u1") + b"\n" + b"{bad\n" + _line("u2", gitBranch="dev") + b'{"uuid":"torn')
    (a / "s2.jsonl").write_bytes(_line("u2") + b'{"cwd":"/w/app"}\n' + b'{"cwd":"/w/app"}\n')
    (b / "s3.jsonl").write_bytes(b'{"uuid":"u9","cwd":"/w/secret"}\n')
    (b / "s4.jsonl").write_bytes(b"{only bad\n")
    (a / "note.txt").write_bytes(_line("u8"))
    return tmp_path


def _tables(path, keep=("results", "requests")):
    return Tables(f"{path}/store", f"{path}/cursors", f"{path}/work", keep=keep, buckets=4)


def _repos(spark):
    return spark.createDataFrame([("/w/app", " git@host:app ", "main"), ("/w/secret", " ", None)], "project_path string, remote string, branch string")


def _pass(spark, tree, tables, **more):
    return run_pass(spark, list_transcripts(spark, f"{tree}/in"), _repos(spark), tables, **more).first().asDict()


def _store(spark, tables):
    return sorted((r.record_key, r.record) for r in tables.stored(spark).collect())


def test_passes_appends_and_replays(spark, tree):
    t = _tables(tree)
    first = _pass(spark, tree, t)
    assert first == {"scanned_files": 2, "uploaded_files": 2, "failed_files": 0, "records_sent": 5, "inserted": 4, "deduped": 1, "skipped_lines": 1, "accepted_files": 2, "duplicate_files": 0}
    assert not any("secret" in r for _, r in _store(spark, t))
    assert _pass(spark, tree, t)["scanned_files"] == 0
    with (tree / "in/-w-app/s1.jsonl").open("ab") as f:
        f.write(b'"}\n' + _line("u3"))
    assert _pass(spark, tree, t)["inserted"] == 2
    whole = _store(spark, t)
    # a lost cursor table: everything is read again, nothing is stored twice
    again = Tables(t.store, f"{tree}/lost", t.work)
    assert _pass(spark, tree, again)["inserted"] == 0
    assert _store(spark, t) == whole
    # one pass over the grown tree stores the same
    other = Tables(f"{tree}/store2", f"{tree}/cursors2", t.work)
    _pass(spark, tree, other)
    assert _store(spark, other) == whole


def test_a_crash_between_store_and_cursors(spark, tree):
    t = _tables(tree)
    assert _pass(spark, tree, t, commit_cursors=False)["inserted"] == 4
    assert load_cursors(spark, t.cursors).count() == 0
    again = _pass(spark, tree, t)
    assert (again["inserted"], again["deduped"]) == (0, 5)
    assert load_cursors(spark, t.cursors).count() == 2


def test_project_filter_and_missing_root(spark, tree):
    assert _pass(spark, tree, _tables(tree), project="nothing")["scanned_files"] == 0
    assert read_transcripts(spark, f"{tree}/absent").count() == 0


def test_a_failing_chunk_holds_its_files_cursor(spark, tree):
    t = _tables(tree)
    (tree / "in/-w-app/s2.jsonl").write_bytes(b"".join(_line(f"k{i}") for i in range(5)))

    def deliver(requests, broken=True):
        bad = F.col("file_path").endswith("s2.jsonl") & (F.col("chunk_no") == 1) & F.lit(broken)
        rows = requests.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.when(bad, 4).otherwise(1))))
        return rows.select("file_path", "chunk_no", "attempt", F.when(bad, 503).otherwise(200).alias("status"))

    limits = Limits(request_records=2)
    first = _pass(spark, tree, t, sender=Sender(deliver=deliver), limits=limits)
    assert first == {"scanned_files": 2, "uploaded_files": 1, "failed_files": 1, "records_sent": 7, "inserted": 2, "deduped": 0, "skipped_lines": 1, "accepted_files": 1, "duplicate_files": 0}
    assert sorted(k for k, _ in _store(spark, t)) == ["k0", "k1", "u1", "u2"]  # chunks before the failure are stored
    assert [r.file_path[-8:] for r in load_cursors(spark, t.cursors).collect()] == ["s1.jsonl"]
    results = spark.read.parquet(f"{t.work}/*/results").where("not ok").collect()
    assert [(r.first_failed, r.error) for r in results] == [(1, "transient failure, status 503, chunk 1")]
    again = _pass(spark, tree, t, sender=Sender(deliver=lambda r: deliver(r, False)), limits=limits)
    assert (again["uploaded_files"], again["inserted"], again["deduped"]) == (1, 3, 2)
    assert _pass(spark, tree, t)["scanned_files"] == 0


def test_no_body_is_over_its_budget(spark, tree):
    t = _tables(tree)
    rows = [b'{"a":' + b" " * 5000 + b"1}", b'{"n":1e2,"m":1.0}', b'{"a":1,"a":2}', b'{"b":1,"7":[ ]}', b'"\\u00e9"', json.dumps({"cwd": "/w/app", "x": "y" * 9000}).encode()]
    (tree / "in/-w-app/s1.jsonl").write_bytes(b"\n".join([_line("u1").strip(), *rows]) + b"\n")
    (tree / "in/-w-app/s2.jsonl").unlink()
    _pass(spark, tree, t, limits=Limits(1000, 1500, 400, 100, 100))
    held = {r.record for r in t.stored(spark).collect()}
    assert {'{"a":1}', '{"n":100,"m":1}', '{"a":2}', '{"7":[],"b":1}', '"é"'} <= held
    bodies = [json.loads(r.body) for r in spark.read.parquet(f"{t.work}/*/requests").collect()]
    sizes = [sum(len(json.dumps(x, separators=(",", ":"), ensure_ascii=False).encode()) for f in b["files"] for x in f["records"]) for b in bodies]
    assert sizes and max(sizes) <= 1500


def test_a_dry_run_writes_nothing(spark, tree):
    t = _tables(tree)
    rows = run_pass(spark, list_transcripts(spark, f"{tree}/in"), _repos(spark), t, dry=True).collect()
    assert sorted(map(tuple, rows)) == [("s1", 2, 1, "/w/app"), ("s2", 3, 0, "/w/app")]
    assert t.stored(spark).isEmpty() and load_cursors(spark, t.cursors).isEmpty()


def test_no_payload_is_shuffled_before_the_gate(spark, tree):
    ranges = new_ranges(list_transcripts(spark, f"{tree}/in"), load_cursors(spark, f"{tree}/none"))
    plan = gated_batches(ranges, _repos(spark))._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.split("\n") if "Exchange" in x]
    assert exchanges
    for op in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(gated_batches(ranges, _repos(spark))._jdf.queryExecution().sparkPlan().collectLeaves()):
        assert "content" not in op.toString()
    text = gated_batches(ranges, _repos(spark))._jdf.queryExecution().toString()
    for line in text.split("== Physical Plan ==")[1].split("\n"):
        if "Exchange" in line:
            assert "raw" not in line and "content" not in line


def test_damaged_cursor_tables_are_empty(spark, tree):
    t = _tables(tree)
    _pass(spark, tree, t)
    table = load_cursors(spark, t.cursors)
    save_cursors(table, t.cursors)
    assert load_cursors(spark, t.cursors).count() == 2
    from pathlib import Path

    for f in Path(t.cursors).rglob("*.parquet"):
        f.write_bytes(b"no table")
    for f in Path(t.cursors).rglob(".*.crc"):
        f.unlink()
    assert load_cursors(spark, t.cursors).count() == 0
    assert _pass(spark, tree, t)["inserted"] == 0


def test_the_stream_stores_what_passes_store(spark, tree):
    t = _tables(tree)
    go = lambda: watch(spark, f"{tree}/in", lambda: _repos(spark), t, f"{tree}/checkpoint", seconds=None).awaitTermination(120)
    go()
    assert len(_store(spark, t)) == 4
    with (tree / "in/-w-app/s1.jsonl").open("ab") as f:
        f.write(b'"}\n' + _line("u3"))
    go()
    streamed = _store(spark, t)
    other = Tables(f"{tree}/store2", f"{tree}/cursors2", t.work)
    _pass(spark, tree, other)
    assert _store(spark, other) == streamed


def test_one_shot_runs_take_whole_files_in_small_ranges(spark, tree):
    t = _tables(tree)
    path = tree / "in/-w-app/s5.jsonl"
    # lines without a uuid rest on their position; one line is longer than a range
    path.write_bytes(b"".join(_line(f"v{i}") + b'{"cwd":"/w/app"}\n' for i in range(40)) + _line("long", text="x" * 1000))
    go = lambda: watch(spark, f"{tree}/in", lambda: _repos(spark), t, f"{tree}/checkpoint", seconds=None, range_bytes=200).awaitTermination(120)
    go()
    assert len(_store(spark, t)) == 4 + 81
    with path.open("ab") as f:
        f.write(b"".join(_line(f"w{i}") for i in range(20)))
    go()
    streamed = _store(spark, t)
    assert len(streamed) == 4 + 101
    other = Tables(f"{tree}/store2", f"{tree}/cursors2", t.work)
    _pass(spark, tree, other)
    assert _store(spark, other) == streamed


def test_a_failing_stream_starts_again(spark, tree):
    import threading

    t, stop, calls = _tables(tree), threading.Event(), []

    def repos():
        calls.append(1)
        if len(calls) == 1:
            raise OSError("not now")
        return _repos(spark)

    start = lambda: watch(spark, f"{tree}/in", repos, t, f"{tree}/checkpoint", seconds=None)
    timer = threading.Thread(target=lambda: [stop.wait(0.2) for _ in range(600) if not (len(calls) > 1 and not t.stored(spark).isEmpty())] and stop.set())
    timer.start()
    failures = keep_watching(start, stop, seconds=0.1)
    timer.join()
    assert failures == 1 and len(_store(spark, t)) == 4
