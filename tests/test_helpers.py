import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tailwright.functions.helpers import chunk_numbers, dump, fit_record, fit_records, number, parse, shed


def test_shed_keeps_what_fits():
    value = {"a": "short", "b": ["x", {"c": "y"}]}
    assert shed(value, 1000) == value


def test_shed_counts_the_bytes_lost():
    assert shed("x" * 5000, 1000) == "x" * 1000 + "…<truncated 4000 bytes>"


def test_shed_is_deep_and_leaves_siblings():
    out = shed({"nested": {"huge": "y" * 4000}, "sibling": {"keep": "me"}}, 1000)
    assert out["nested"]["huge"].endswith("<truncated 3000 bytes>") and out["sibling"] == {"keep": "me"}


def test_shed_tests_bytes_but_cuts_units():
    assert shed("é" * 6, 10) == "é" * 6 + "…<truncated 0 bytes>"
    cut = shed("a😀b" * 10, 12)
    assert cut.startswith("a😀b" * 3) and "<truncated 42 bytes>" in cut


def test_long_keys_stay():
    assert shed({"k" * 50: 1}, 10) == {"k" * 50: 1}


def test_records_over_the_budget_are_cut_twice_if_need_be():
    one, size = fit_record(dump({"uuid": "a", "blob": "z" * 4_000_000}), 3_500_000, 131_072, 8_192)
    assert size < 3_500_000 and "truncated" in one
    many = {"uuid": "b"} | {f"f{i}": "z" * 130_000 for i in range(40)}
    two, size = fit_record(dump(many), 3_500_000, 131_072, 8_192)
    assert size < 3_500_000 and parse(two)["f0"].startswith("z" * 8192)


@pytest.mark.parametrize("text", ["null", "123", '"s"', "[1]", '{"a":1,"a":2}'])
def test_any_value_is_a_record(text):
    parse(text)


@pytest.mark.parametrize("text", ['{"a":1} x', '{"a":1}{"b":2}', "1,2", "1],[2", "1}", "{'a':1}", '{"a":1,}', "NaN", '{"a":NaN}', '{"a":01}', "tru", "-", '"a\tb"'])
def test_strict(text):
    with pytest.raises(ValueError):
        parse(text)


@pytest.mark.parametrize(
    ("x", "text"),
    [(1.0, "1"), (1e5, "100000"), (0.1, "0.1"), (1e21, "1e+21"), (1.5e-7, "1.5e-7"), (-0.0, "0"), (123456789012345680000.0, "123456789012345680000"), (1e-6, "0.000001"), (-2.5, "-2.5")],
)
def test_numbers(x, text):
    assert number(x) == text


def test_lone_surrogates_are_escaped():
    assert dump("\ud83d") == '"\\ud83d"'


@given(st.lists(st.integers(1, 50)), st.integers(1, 100), st.integers(1, 5))
def test_chunks_are_greedy_and_within_limits(sizes, budget, most):
    got = chunk_numbers(np.array(sizes, np.int64), budget, most)
    want, chunk, count, held = [], 0, 0, 0
    for s in sizes:
        if count and (held + s > budget or count >= most):
            chunk, count, held = chunk + 1, 0, 0
        want.append(chunk)
        count, held = count + 1, held + s
    assert got.tolist() == want


def test_chunks_of_the_budget_exactly():
    assert chunk_numbers(np.array([5, 5]), 10, 9).tolist() == [0, 0]
    assert chunk_numbers(np.array([5, 6]), 10, 9).tolist() == [0, 1]
    assert chunk_numbers(np.array([99]), 10, 9).tolist() == [0]
    assert chunk_numbers(np.ones(10, int), 100, 3).tolist() == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
    assert chunk_numbers(np.zeros(0, int), 10, 9).tolist() == []


def test_large_batches_of_records_are_cut_in_parts(spark):
    """Of a batch of 12 MB no more than some 2 MB are taken at once, and rows stay in order."""
    texts = ['{"a":"' + "x" * 50_000 + str(i) + '"}' if i % 7 else None for i in range(280)]
    parts = list(fit_records(10, 40, 20).func(iter([pa.array(texts, pa.string())])))
    assert len(parts) >= 5 and sum(map(len, parts)) == 280
    want = [None if t is None else fit_record(t, 10, 40, 20)[0] for t in texts]
    assert [r["record"] for p in parts for r in p.to_pylist()] == want
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    got = {r.i: r.cut.record for r in df.select("i", fit_records(10, 40, 20)("t").alias("cut")).collect()}
    assert got == dict(enumerate(want))
