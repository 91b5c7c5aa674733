from pyspark.sql import functions as F

from tailwright.functions.session import prepare_session
from tailwright.functions.text import decode_project_dir, session_id
from tailwright.operators.batches import project_filter
from tailwright.operators.lines import batch_sha256, line_offsets, split_lines
from tailwright.operators.records import parse_lines
from tailwright.sources.transcripts import slice_at_cursor


def _files(spark, *contents):
    return spark.createDataFrame([(f"/p/-a/f{i}.jsonl", bytearray(c)) for i, c in enumerate(contents)], "file_path string, content binary")


def test_lines_and_offsets_count_bytes_of_the_file(spark):
    files = _files(spark, b"\xff\xc3\xa9\n\nx\ntail", b"only a tail", b"", b"\n")
    rows = sorted(map(tuple, line_offsets(split_lines(files)).select("file_path", "line_no", "byte_start", "byte_len", "raw").collect()))
    assert rows == [("/p/-a/f0.jsonl", 0, 0, 3, "�é"), ("/p/-a/f0.jsonl", 1, 4, 0, ""), ("/p/-a/f0.jsonl", 2, 5, 1, "x"), ("/p/-a/f3.jsonl", 0, 0, 0, "")]
    assert sorted(r.consumed for r in batch_sha256(files).collect()) == [1, 7]


def test_records_blank_lines_and_malformed_ones(spark):
    prepare_session(spark)
    good = ["null", "123", '"s"', "[1]", '{"a":1,"a":2}', '﻿{"uuid":"u1"}', " 1", '{"cwd":"/x"}\r', '{"cwd":5}', '{"cwd":""}', '[{"cwd":"/y"}]', '{"a":{"cwd":"/z"}}']
    bad = ['{"a":1} x', '{"a":1}{"b":2}', "1,2", "1],[2", "1}", "{'a':1}", '{"a":1,}', "NaN", '{"a":01}', "tru", "-", '"a\tb"']
    blank = ["", " \t", " "]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(good + bad + blank)], "file_path string, line_no long, raw string")
    rows = {r.line_no: r for r in parse_lines(lines).collect()}
    assert sorted(rows) == list(range(len(good) + len(bad)))
    assert [rows[i].valid for i in sorted(rows)] == [True] * len(good) + [False] * len(bad)
    assert rows[5].uuid == "u1" and rows[7].cwd == "/x"
    assert all(rows[i].cwd is None for i in (8, 9, 10, 11))


def test_deep_values_get_a_second_look(spark):
    prepare_session(spark)
    deep = "[" * 700 + "]" * 700
    lines = spark.createDataFrame([("f", 0, deep), ("f", 1, deep[:-1])], "file_path string, line_no long, raw string")
    assert [r.valid for r in parse_lines(lines).orderBy("line_no").collect()] == [True, False]


def test_paths(spark):
    rows = [("/r/-home-ana-src-foo/s.jsonl",), ("/r/plain-dir/t.jsonl",), ("/r/-/u.jsonl",), ("bare.jsonl",)]
    df = spark.createDataFrame(rows, "p string").select(decode_project_dir(F.col("p")), session_id(F.col("p")))
    assert [tuple(r) for r in df.collect()] == [("/home/ana/src/foo", "s"), ("plain/dir", "t"), ("/", "u"), ("", "bare")]


def test_cursors_at_and_beyond_the_end(spark):
    files = _files(spark, b"a\nb\n", b"a\nb\n", b"a\nb\n", b"a\nb\n")
    cursors = spark.createDataFrame([("/p/-a/f0.jsonl", 4, 2), ("/p/-a/f1.jsonl", 9, 3), ("/p/-a/f2.jsonl", 2, 1)], "file_path string, bytes_uploaded long, lines_uploaded long")
    got = lambda mode: sorted((r.file_path[-7], bytes(r.content), r.start, r.lines_before) for r in slice_at_cursor(files, cursors, mode).collect())
    assert got("restart") == [("1", b"a\nb\n", 0, 0), ("2", b"b\n", 2, 1), ("3", b"a\nb\n", 0, 0)]
    assert got("skip") == [("2", b"b\n", 2, 1), ("3", b"a\nb\n", 0, 0)]


def test_filter_is_literal(spark):
    df = spark.createDataFrame([("/a_b%c",), ("/axbc",)], "project_path string")
    count = lambda part: project_filter(df, part).count()
    assert [count("%"), count("_"), count("A_B"), count(""), count(None)] == [1, 1, 0, 2, 2]
