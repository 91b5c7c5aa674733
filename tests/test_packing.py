import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tailwright.functions.helpers import chunk_numbers, exits
from tailwright.operators.budget import pack_chunks


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=60), st.integers(1, 60), st.integers(1, 7), st.data())
def test_exits_are_where_sequential_cuts_lead(sizes, budget, records, data):
    own = data.draw(st.integers(1, len(sizes)))
    reach = np.array(sizes[: own + records])
    jump, steps = exits(reach, own, budget, records)
    for at in range(min(own, records)):
        chunk = chunk_numbers(np.array(sizes[at:]), budget, records)
        begins = at + np.flatnonzero(np.diff(chunk, prepend=-1))
        want = begins[begins >= own]
        assert steps[at] == (begins < own).sum()
        if len(want) and want[0] < len(reach):
            assert jump[at] == want[0]
        else:
            assert jump[at] == min(len(sizes), len(reach))


@pytest.mark.parametrize(("segment", "budget", "records"), [(10, 50, 4), (16, 1000, 16), (7, 30, 7), (50, 5, 3)])
def test_segments_of_a_large_file_give_the_sequential_chunks(spark, segment, budget, records):
    rng = np.random.default_rng(segment)
    rows, want = [], set()
    for f, n in (("/big", 237), ("/even", 4 * segment), ("/small", segment), ("/one", 1)):
        lines = np.sort(rng.choice(3 * n, n, replace=False))
        sizes = rng.integers(0, 40, n)
        rows += [(f, int(x), int(s)) for x, s in zip(lines, sizes, strict=True)]
        want |= {(f, int(x), int(c)) for x, c in zip(lines, chunk_numbers(sizes, budget, records), strict=True)}
    rng.shuffle(rows)
    df = spark.createDataFrame([(f, int(x), int(s)) for f, x, s in rows], "file_path string, line_no long, wire_bytes long").repartition(5)
    got = [tuple(r) for r in pack_chunks(df, budget, records, segment).collect()]
    assert len(got) == len(rows) and set(got) == want
