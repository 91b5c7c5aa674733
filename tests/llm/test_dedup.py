import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tailwright.llm.common import Workspace
from tailwright.llm.components import connected_components
from tailwright.llm.embedding_dedup import dedup_embeddings, passes_for, seams_of
from tailwright.llm.minhash_dedup import bands_for, dedup_documents, minmax, permutations, plausible_for

from .conftest import words


def _groups(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def _shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, i) for i in range(6, 30)] + [(3, 3), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in connected_components(df, Workspace(spark, "t")).collect()}
    want = _groups({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if k != 3}
    assert connected_components(df.limit(0), Workspace(spark, "t")).count() == 0


def test_near_copies_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    docs = []
    for g in range(12):
        base = words(g, 150)
        for c in range(10):
            w = list(base)
            for k in rng.integers(0, 150, c):  # growing distances: some pairs lie on either side
                w[k] = f"x{rng.integers(1 << 30)}"
            docs.append((len(docs), " ".join(w)))
    docs += [(1000, "a b"), (1001, "A  b"), (1002, "a b c"), (1003, ""), (1004, None)]
    got = {r.doc_id: r for r in dedup_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = {d: _shingles(t) for d, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = _groups(sets, links)
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(r.n_shingles == len(sets[d]) and r.kept == (d == want[d]) for d, r in got.items())
    assert len(set(want.values())) < len(docs)


def test_bands_and_cut_follow_the_threshold():
    assert bands_for(85) == 32 and plausible_for(85, 192) == 0.72
    assert bands_for(80) == 50 and plausible_for(80, 300) == 0.68 and bands_for(100) == 1
    assert all((1 - (p / 100) ** 6) ** bands_for(p) <= 3e-7 for p in range(50, 100))


def test_the_stage_against_all_pairs_around_its_threshold(spark):
    rng = np.random.default_rng(7)
    docs = []
    for g in range(40):
        base = words(100 + g, 160)
        docs.append((len(docs), " ".join(base)))
        # similarity to the base goes down from 0.88 to 0.68
        changed = list(base)
        for k in range(2 + g % 5):
            changed[10 + 25 * k] = f"x{rng.integers(1 << 30)}"
        docs.append((len(docs), " ".join(changed)))
    sets = {d: _shingles(t) for d, t in docs}
    same = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert sum(0.8 <= x < 0.85 for x in same.values()) >= 8 and sum(0.7 < x < 0.8 for x in same.values()) >= 8
    want = _groups(sets, [p for p, x in same.items() if x >= 0.8])
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.minhash_dedup(spark, df, "").collect()}
    assert got == {d for d, root in want.items() if d == root}


def test_minmax_estimates_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    sig = minmax([np.unique(x[:2000]), np.unique(x[500:2500])], *permutations(400))
    assert abs((sig[0] == sig[1]).mean() - 1500 / 2500) < 0.06


def test_odd_documents(odd_docs, no_docs):
    rows = dedup_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert [by[i].component_id for i in (1, 2, 8)] == [1, 1, 1] and by[3].n_shingles == 0 and by[6].n_shingles == 1
    assert all(by[i].component_id == i and by[i].kept for i in (3, 4, 5, 6, 7))
    assert dedup_documents(no_docs).count() == 0


def _brute(rows, cosine=0.98):
    good = {}
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            good[i] = np.array(v, float) / np.linalg.norm(v)
    return [(i, j) for i in good for j in good if i < j and rows[i][2] == rows[j][2] and len(good[i]) == len(good[j]) and good[i] @ good[j] >= cosine]


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(30):
        c = rng.standard_normal(32)
        for _ in range(1 + g * 2 % 7):
            rows.append((len(rows), (c + rng.standard_normal(32) * 0.12).tolist(), g % 3))
    crowd = rng.standard_normal(32)
    rows += [(len(rows) + i, (crowd + rng.standard_normal(32) * 0.08).tolist(), 1) for i in range(300)]
    rows += [(len(rows) + i, crowd.tolist(), 1) for i in range(50)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 32, 1), (n + 2, [None] * 32, 1), (n + 3, [float("nan")] * 32, 1), (n + 4, crowd.tolist(), None), (n + 5, [], 1), (n + 6, crowd.tolist()[:16], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    got = {r.vec_id: r for r in dedup_embeddings(df).collect()}
    links = _brute(rows)
    count = np.zeros(len(rows), int)
    for a, b in links:
        count[[a, b]] += 1
    want = _groups(range(len(rows)), links)
    assert {i: r.component_id for i, r in got.items()} == want
    assert [got[i].n_links for i in range(len(rows))] == count.tolist()
    assert all(r.kept == (i == want[i]) for i, r in got.items())


def test_small_partitions_cut_no_window(spark):
    """Every pair within a window of the sorted order is found, though partitions hold a few rows each."""
    rng = np.random.default_rng(5)
    rows = []
    while len(rows) < 1200:
        c = rng.standard_normal(16)
        rows += [(len(rows) + i, (c + rng.standard_normal(16) * 0.09).tolist(), 1) for i in range(int(rng.integers(1, 4)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    links = _brute(rows)
    want = _groups(range(len(rows)), links)
    assert len(links) > 300
    few, many = ({r.vec_id: r.component_id for r in dedup_embeddings(df, passes=p, partitions=200).collect()} for p in (1, 20))
    assert many == want  # recall of 1 against brute force at 200 partitions
    one = {r.vec_id: r.component_id for r in dedup_embeddings(df, passes=1, partitions=1).collect()}
    assert few == one and one != want


def test_seams_of_small_partitions():
    assert seams_of({0: 5, 2: 1, 3: 5}, 5) == [(0, 0, 0), (2, 1, 0), (3, 1, 0), (2, 0, 2), (0, 0, 2), (3, 1, 2)]
    assert seams_of({4: 2}, 5) == [] and passes_for(5000, 0.98) == 20 < passes_for(30_000_000, 0.98) < 80


def test_vectors_at_the_threshold_and_extra_columns(spark):
    """A cosine of the threshold itself links; columns of other names go their way."""
    v = [(1, [1.0, 1.0, 1.0, 1.0], 1), (2, [1.0, 0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit("x")).withColumn("component_id", F.lit(9)).withColumn("key", F.lit(None))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in dedup_embeddings(df, cosine=0.5).collect()) == [(1, 1, 1), (2, 1, 1)]
    assert [r.n_links for r in dedup_embeddings(df, cosine=0.5000001).collect()] == [0, 0]


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1)]])
def test_few_vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in dedup_embeddings(df).collect())
    assert got == ([(1, 2, 1), (1, 2, 1), (2, 2, 1)] if rows else [])
