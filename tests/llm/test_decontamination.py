import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tailwright.llm.common import Workspace
from tailwright.llm.decontamination import build_index, contamination, remove_spans, report, search_index
from tailwright.llm.fm_index import FMIndex
from tailwright.llm.oracles import DECONTAMINATION_SQL

from .conftest import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def _brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = WORD.findall(_lower(text))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w = WORD.findall(_lower(text))
        hit, found = set(), set()
        for n in {len(p) for p in windows}:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= {str(x) for x in windows[p] if x is not None}
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=40), min_size=1, max_size=6), st.lists(st.lists(st.integers(-1, 4), min_size=1, max_size=5), min_size=1, max_size=8))
def test_index_finds_all_places(texts, phrases):
    lengths = np.array([len(t) for t in texts])
    index = FMIndex.build(np.array([w for t in texts for w in t], np.int64), lengths, 5)
    index = FMIndex.of(index.size, {k: pa.py_buffer(v) for k, v in index.arrays().items()})
    laid = [w for t in texts for w in [*t, None]]
    packed = np.full((len(phrases), 6), -1)
    for k, p in enumerate(phrases):
        packed[k, 6 - len(p) :] = p
    low, high = index.search(packed, np.array([len(p) for p in phrases]))
    for k, p in enumerate(phrases):
        assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == [i for i in range(len(laid)) if laid[i : i + len(p)] == p]


def _made(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(words(seed * 100 + i, rng.choice([3, 9, 10, 11, 40])))) for i in range(12)]
    items += [(50, ""), (51, None), (52, "..."), (None, " ".join(words(7, 12))), (3, items[3][1]), (60, items[0][1] + " " + items[1][1])]
    docs = []
    for d in range(60):
        w = words(1000 + d, rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            part = (rng.choice(items)[1] or "").split()
            at, cut = rng.randint(0, len(w)), rng.randint(0, 3)
            w[at:at] = [x.upper() if x.isascii() and rng.random() < 0.3 else x for x in part[cut:]]
        docs.append((d, rng.choice([" ", "\n", ", ", "-"]).join(w)))
    return [*docs, (5, docs[5][1]), (7, docs[6][1]), (100, None), (101, ""), (102, "?!"), (None, items[4][1])], items


def test_report_equals_brute_force_and_sql(spark):
    docs, items = _made(1)
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, spans string")
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, row string")
    want = _brute(docs, items)
    assert sum(r[2] > 0 for r in want) > 20
    assert _rows(report(contamination(d, i))) == want
    # parts of long texts, and windows in several blocks
    assert _rows(report(contamination(d.repartition(5), i, part_words=23))) == want
    ws = Workspace(spark, "t")
    assert _rows(report(search_index(build_index(d, ws, part_words=50), i, ws, pairs=40))) == want
    con = duckdb.connect()
    con.register("documents", d.toArrow())
    con.register("benchmark", i.toArrow())
    assert sorted(con.sql(DECONTAMINATION_SQL).fetchall(), key=repr) == want


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    text = odd_docs.where("doc_id = 1").first().text
    items = spark.createDataFrame([(1, text), (2, "one two"), (3, None)], "item_id long, text string")
    want = _brute([(r.doc_id, r.text) for r in odd_docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert _rows(report(contamination(odd_docs, items))) == want
    assert contamination(no_docs, items).count() == 0
    none = report(contamination(odd_docs, items.limit(0)))
    assert none.count() == odd_docs.count() and none.where("contaminated OR n_hit > 0").count() == 0


def test_removal_cuts_what_was_found_and_nothing_else(spark):
    secret = " ".join(words(1, 12))
    loud = "".join(c.upper() if c.isascii() else c for c in secret)
    docs = spark.createDataFrame([(1, f"Before it, {loud}! After é.", "a"), (2, "nothing here", None), (None, secret, "b"), (3, None, "c"), (1, "other text", "d")], "doc_id long, text string, tag string")
    items = spark.createDataFrame([(9, secret)], "item_id long, text string")
    got = {(r.doc_id, r.tag): r.text for r in remove_spans(docs, contamination(docs, items)).collect()}
    assert got == {(1, "a"): "Before it, ! After é.", (2, None): "nothing here", (None, "b"): "", (3, "c"): None, (1, "d"): "other text"}


def test_a_common_passage_in_many_rows(spark):
    secret = " ".join(words(1, 30))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("x "), F.lit(secret), F.lit(" y"))).otherwise("clean").alias("text"))
    got = report(contamination(docs, spark.createDataFrame([(i, secret) for i in range(50)], "item_id long, text string")))
    assert got.groupBy("contaminated", "n_hit", "n_items").count().orderBy("n_hit").collect() == [(False, 0, 0, 2000), (True, 30, 50, 1000)]
