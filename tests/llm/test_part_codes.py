import hashlib
import math

import duckdb
import numpy as np
import pytest

from tailwright.llm.oracles import part_codes_sql
from tailwright.llm.part_codes import PARTS, STATE, assign, code_vectors, distances

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def _brute(rows, rounds=6):
    """All parts against all entries, in Python integers."""
    kept = [(i, [math.floor(4096 * x) for x in v], c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1]) // PARTS
    part = lambda v, p: v[p * d : (p + 1) * d]
    books = [[part(v, p) for _, v, _ in kept[:16]] for p in range(PARTS)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def near(v, p):
        return min((dist(part(v, p), c), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(PARTS):
            of = {}
            for _, v, _ in kept:
                of.setdefault(near(v, p)[1], []).append(part(v, p))
            new.append([[sum(k) // len(of[e]) for k in zip(*of[e], strict=True)] if e in of else c for e, c in enumerate(books[p])])
        books = new
    out, by_label = [], {}
    for i, v, c in kept:
        m = [near(v, p) for p in range(PARTS)]
        out.append((i, "".join(f"{e:02x}" for _, e in m), sum(x for x, _ in m), c))
        by_label[c] = by_label.get(c, 0) + out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, code, e, by_label[c], sha) for i, code, e, c in out), key=repr)


def _vectors(seed, n, width=16):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(20, width))
    v = (centers[rng.integers(0, 20, n)] + rng.normal(scale=0.2, size=(n, width))).astype(np.float32)
    return [(int(i), v[i].tolist(), int(i % 5) if i % 7 else None) for i in range(n)]


def _got(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=repr)


def test_codes_equal_brute_force(spark):
    rows = _vectors(1, 250)
    rows += [(3, rows[3][1], 2), (3, rows[3][1], 2), (300, [0.0] * 16, None), (None, rows[5][1], 1)]  # repeated, all zero, without id
    rows += [(400, None, 1), (401, [math.nan] + [0.0] * 15, 1), (402, [math.inf] + [0.0] * 15, 1), (403, [None] + [0.0] * 15, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    want = _brute(rows)
    assert _got(code_vectors(df)) == want
    assert _got(code_vectors(df.repartition(7))) == want


def test_few_and_no_vectors(spark):
    rows = _vectors(2, 5)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = _got(code_vectors(df))
    assert got == _brute(rows) and all(r[2] == 0 for r in got)
    assert code_vectors(df.limit(0)).collect() == []


def test_vectors_that_fit_no_codebook_stay_without_code(spark):
    rows = _vectors(3, 30)
    odd = [(1000, [0.5] * 8, 1), (1001, [1e30] * 16, 1), (1002, [], 1), (1003, [0.5] * 15, 2)]
    got = _got(code_vectors(spark.createDataFrame([(*r, "x") for r in rows + odd], SCHEMA)))
    assert [r for r in got if r[0] < 1000] == _brute(rows)
    assert sorted((r[0], r[1], r[2]) for r in got if r[0] >= 1000) == [(i, None, None) for i in range(1000, 1004)]


def test_sql_gives_the_same_rows(spark):
    rows = _vectors(4, 120, 64)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    assert _got(code_vectors(df)) == sorted(con.sql(part_codes_sql()).fetchall(), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_bounds_avoid_rescans_and_change_nothing(seed):
    rng = np.random.default_rng(seed)
    centers = rng.integers(-4000, 4000, (16, PARTS, 4))
    x = centers[rng.integers(0, 16, 3000)] + rng.integers(-300, 300, (3000, PARTS, 4))
    history = [x[:16].transpose(1, 0, 2).copy()]
    state = np.zeros(len(x), STATE)
    scanned = []
    for _ in range(8):
        scanned.append(assign(x, state, history))
        for p in range(PARTS):
            assert (state["code"][:, p] == distances(x[:, p], history[-1][p]).argmin(axis=1)).all()
        new = history[-1].copy()
        for p in range(PARTS):
            for e in range(16):
                if (own := state["code"][:, p] == e).any():
                    new[p, e] = x[own, p].sum(axis=0) // own.sum()
        history.append(new)
    assert scanned[0] == 3000 * PARTS and scanned[-1] < 0.2 * scanned[0]
