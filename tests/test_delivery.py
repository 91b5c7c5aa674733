"""Requests go out in order; batches are delivered once; a pass that died goes on."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tailwright.plans.delivery import Sender, deliver_requests
from tailwright.plans.incremental import Limits, Tables, ingest, sweep
from tailwright.sources.transcripts import list_transcripts, load_cursors
from tailwright.streaming.watch import watch

REPOS = [("/w/app", "git@host:app", "main")]


def _line(uuid, **more):
    return json.dumps({"uuid": uuid, "cwd": "/w/app", **more}).encode() + b"\n"


@pytest.fixture
def at(tmp_path):
    (tmp_path / "in/-w-app").mkdir(parents=True)
    return tmp_path


def _repos(spark):
    return spark.createDataFrame(REPOS, "project_path string, remote string, branch string")


def _tables(at, name="t", keep=("results",)):
    return Tables(f"{at}/{name}/store", f"{at}/{name}/cursors", f"{at}/{name}/work", keep=keep, buckets=4)


def _ingest(spark, at, tables, **more):
    return ingest(spark, list_transcripts(spark, f"{at}/in"), _repos(spark), tables, **more)


def _keeper(tmp):
    made = []

    def keep(df, name):
        df = df() if callable(df) else df
        df.write.mode("overwrite").parquet(f"{tmp}/{name}")
        made.append(name)
        return df.sparkSession.read.schema(df.schema).parquet(f"{tmp}/{name}")

    return keep, made


def _requests(spark):
    rows = [(f"/f{k}", c, f"{k}-{c}") for k in range(4) for c in range(k + 2)]
    return spark.createDataFrame(rows, "file_path string, chunk_no long, body string")


def _receiver(log, statuses):
    """A receiver that keeps what it is sent; ``statuses``: of (file, chunk), attempt by attempt, 200 for all else."""

    def send(path, chunk, body):
        seen = [json.loads(x) for x in Path(log).read_text().splitlines()] if Path(log).exists() else []
        tries = sum(x[:2] == [path, chunk] for x in seen)
        status = statuses.get((path, chunk), [])[tries : tries + 1] or [200]
        with Path(log).open("a") as f:
            f.write(json.dumps([path, chunk, body, status[0]]) + "\n")
        return status[0]

    return send


def _told(log):
    return [json.loads(x) for x in Path(log).read_text().splitlines()]


BAD = {("/f2", 1): [503, 429, None, 503], ("/f3", 0): [500, 200], ("/f3", 2): [413]}


def _check_order(told):
    for path in {x[0] for x in told}:
        own = [x for x in told if x[0] == path]
        chunks = [x[1] for x in own]
        assert chunks == sorted(chunks)
        last = [s for _, c, _, s in own if c == max(chunks)][-1]
        failed = last is None or not 200 <= last < 300
        assert failed == (path in ("/f2", "/f3"))
        assert max(chunks) == {"/f0": 1, "/f1": 2, "/f2": 1, "/f3": 2}[path]


def test_tasks_send_no_chunk_behind_a_failed_one(spark, tmp_path):
    keep, _ = _keeper(tmp_path / "k")
    sender = Sender(send=_receiver(f"{tmp_path}/log", BAD))
    made = deliver_requests(_requests(spark).coalesce(1), sender, 4, keep, first_wait=0.0).collect()
    told = _told(f"{tmp_path}/log")
    _check_order(told)
    assert sorted(((r.file_path, r.chunk_no, r.status) for r in made), key=repr) == sorted(((p, c, s) for p, c, _, s in told), key=repr)
    assert sorted(r.attempt for r in made if (r.file_path, r.chunk_no) == ("/f2", 1)) == [1, 2, 3, 4]


def test_rounds_send_no_chunk_behind_a_failed_one(spark, tmp_path):
    keep, names = _keeper(tmp_path / "k")
    send = _receiver(f"{tmp_path}/log", BAD)

    def deliver(requests):
        rows = [(r.file_path, r.chunk_no, 1, send(r.file_path, r.chunk_no, r.body)) for r in sorted(requests.collect(), key=lambda r: (r.file_path, r.chunk_no))]
        return spark.createDataFrame(rows, "file_path string, chunk_no long, attempt int, status int")

    made = deliver_requests(_requests(spark), Sender(deliver=deliver), 4, keep).collect()
    told = _told(f"{tmp_path}/log")
    _check_order(told)
    assert len(made) == len(told)
    # one round for each place in a file; retries belong to their round
    assert [n for n in names if n.startswith("attempts")] == ["attempts-0-0", "attempts-0-1", "attempts-1-0", "attempts-1-1", "attempts-1-2", "attempts-1-3", "attempts-2-0"]


def test_a_batch_delivered_before_is_a_duplicate(spark, at):
    t = _tables(at)
    path = at / "in/-w-app/s1.jsonl"
    path.write_bytes(_line("u1") + b'{"cwd":"/w/app"}\n')
    first = _ingest(spark, at, t)
    assert first.summary.first().asDict() | {"inserted": 2, "accepted_files": 1, "duplicate_files": 0} == first.summary.first().asDict()
    # moved to another folder: the same session, place and bytes
    (at / "in/-w-other").mkdir()
    path.rename(at / "in/-w-other/s1.jsonl")
    second = _ingest(spark, at, t)
    got = second.summary.first()
    assert (got.uploaded_files, got.accepted_files, got.duplicate_files, got.inserted, got.deduped) == (1, 0, 1, 0, 2)
    assert [(r.ok, r.duplicate, r.chunks) for r in second.files.collect()] == [(True, True, 0)]
    # the same bytes again, at another place of the file, are new
    with (at / "in/-w-other/s1.jsonl").open("ab") as f:
        f.write(_line("u1") + b'{"cwd":"/w/app"}\n')
    third = _ingest(spark, at, t).summary.first()
    assert (third.accepted_files, third.duplicate_files, third.inserted, third.deduped) == (1, 0, 1, 1)
    assert _ingest(spark, at, t).summary.first().scanned_files == 0


def test_a_pass_that_died_goes_on_and_delivers_once(spark, at):
    t = _tables(at)
    (at / "in/-w-app/s1.jsonl").write_bytes(b"".join(_line(f"k{i}") for i in range(6)))
    log = f"{at}/log"
    limits = Limits(request_records=2)
    send = _receiver(log, {})

    def deliver(requests, die=False):
        rows = [(r.file_path, r.chunk_no, 1, send(r.file_path, r.chunk_no, r.body)) for r in requests.collect()]
        if die and rows[0][1] == 1:
            raise OSError("gone")
        return spark.createDataFrame(rows, "file_path string, chunk_no long, attempt int, status int")

    with pytest.raises(OSError):
        _ingest(spark, at, t, limits=limits, key="p1", sender=Sender(deliver=lambda r: deliver(r, True)))
    assert load_cursors(spark, t.cursors).isEmpty()
    # the round that was finished is not repeated; the one that died is
    run = _ingest(spark, at, t, limits=limits, key="p1", sender=Sender(deliver=deliver))
    assert [x[1] for x in _told(log)] == [0, 1, 1, 2] and run.summary.first().inserted == 6
    again = _ingest(spark, at, t, limits=limits, key="p1", sender=Sender(deliver=deliver))
    assert again.summary.first() == run.summary.first() and again.files.collect() == run.files.collect()
    assert len(_told(log)) == 4 and t.stored(spark).count() == 6
    # what is left of it is what the manifest names
    assert sorted(p.name for p in Path(f"{t.work}/p1").iterdir()) == ["manifest", "results"]


def test_sweep_leaves_what_manifests_name(spark, at):
    t = _tables(at)
    (at / "in/-w-app/s1.jsonl").write_bytes(_line("u1"))
    _ingest(spark, at, t, key="done")
    _ingest(spark, at, t, key="open", commit_cursors=False)
    spark.range(1).write.parquet(f"{t.work}/done/left")
    before = {p.name for p in Path(f"{t.work}/open").iterdir()}
    sweep(spark, t.work)
    assert sorted(p.name for p in Path(f"{t.work}/done").iterdir()) == ["manifest", "results"]
    assert {p.name for p in Path(f"{t.work}/open").iterdir()} == before


def test_a_dry_run_has_its_line(spark, at):
    (at / "in/-w-app/s1.jsonl").write_bytes(_line("u1") + b"{bad\n" + _line("u2"))
    run = _ingest(spark, at, _tables(at), dry=True)
    assert run.line.first().summary == "dry-run: 1 file(s), 2 new record(s) would be sent, 1 malformed skipped"
    assert [tuple(r) for r in run.files.collect()] == [("s1", 2, 1, "/w/app")]


def test_watch_cuts_records_as_passes_do_and_holds_failed_files(spark, at):
    a, b = _tables(at, "a", ("results", "requests")), _tables(at, "b", ("results", "requests"))
    (at / "in/-w-app/s1.jsonl").write_bytes(_line("big", blob="x" * 4_000_000) + _line("u1"))
    (at / "in/-w-app/s2.jsonl").write_bytes(_line("u2"))

    def deliver(requests, bad=True):
        status = F.when(F.col("file_path").endswith("s2.jsonl") & F.lit(bad), 503).otherwise(200)
        return requests.select("file_path", "chunk_no", F.lit(1).alias("attempt"), status.cast("int").alias("status"))

    runs = []
    go = lambda bad: watch(spark, f"{at}/in", lambda: _repos(spark), a, f"{at}/checkpoint", seconds=None, sender=Sender(deliver=lambda r: deliver(r, bad)), told=runs.append).awaitTermination(300)
    go(True)
    assert sorted((r.file_path[-8:], r.ok) for r in runs[0].files.collect()) == [("s1.jsonl", True), ("s2.jsonl", False)]
    go(False)  # nothing grew: the next batch takes up what was held
    assert [(r.file_path[-8:], r.ok, r.inserted) for r in runs[1].files.collect()] == [("s2.jsonl", True, 1)]
    go(False)
    assert len(runs) == 2 or runs[2].summary.first().scanned_files == 0
    _ingest(spark, at, b)
    rows = lambda t: sorted(map(tuple, t.stored(spark).drop("file_path").collect()), key=repr)
    assert rows(a) == rows(b)
    assert max(len(r[-1]) for r in rows(a)) < 140_000
    bodies = lambda t: {r.body for r in spark.read.parquet(f"{t.work}/*/requests").collect()}
    assert bodies(a) == bodies(b)
    with (at / "in/-w-app/s2.jsonl").open("ab") as f:
        f.write(_line("u3"))
    go(False)
    assert runs[-1].summary.first().inserted == 1 and a.stored(spark).count() == 4
