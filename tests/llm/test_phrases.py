import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tailwright.llm import phrases
from tailwright.llm.common import Workspace
from tailwright.llm.oracles import PHRASES_SQL
from tailwright.llm.phrases import count_phrases, mine_phrases


def _pieces(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
        yield [w for w in re.split(r"[\x20\x09]+", piece) if w]


def _counts(docs):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for w in _pieces(text):
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return f, n


def _brute(docs, least=30, top=2000):
    f, n = _counts(docs)
    f = {k: v for k, v in f.items() if v >= least}
    out = {}
    for (lang, p), a in f.items():
        longer = [v for (x, q), v in f.items() if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if len(p) == 1 or any(100 * v >= 80 * a for v in longer):
            continue
        score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for lang, rows in out.items() for i, (score, a, p, left, right) in enumerate(sorted(rows)[:top]))


def _docs(seed, n=250):
    rng = random.Random(seed)
    known = ["the", "of", "a", "Be", "é", "xy", "x-y", " ", "to"]
    fixed = ["in spite of", "the state of the art", "a a a a a", "new york city council"]
    out = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(known) + str(rng.randint(0, 3)) * (rng.random() < 0.3) for _ in range(rng.randint(0, 30))]
        out.append((rng.choice(["en", "de", None]), "".join(p + rng.choice([" ", " ", " ", "\t", ", ", ".\n", "  "]) for p in parts)))
    return [*out, ("en", None), ("en", ""), (None, " . "), ("fr", "one two"), ("", "the the the")]


def _df(spark, docs):
    return spark.createDataFrame([(*d, "x") for d in docs], "lang string, text string, rank string")


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_phrases_equal_brute_force_and_sql(spark):
    docs = _docs(1)
    df = _df(spark, docs)
    want = _brute(docs)
    assert len(want) > 15 and any(r[2].count(" ") == 3 for r in want)
    assert _rows(mine_phrases(df.repartition(6))) == want
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    assert sorted(con.sql(PHRASES_SQL).fetchall()) == want


@pytest.mark.parametrize("shards, bits", [(1, 57), (3, 9), (10, 57)])
def test_any_shards_and_clashing_hashes_give_the_same_counts(spark, shards, bits):
    docs = _docs(2, 150)
    want = {(lang, " ".join(p), v) for (lang, p), v in _counts(docs)[0].items() if v >= 8}
    got, sizes = count_phrases(_df(spark, docs), Workspace(spark, "t"), 8, shards, bits)
    assert {(r.lang, r.phrase, r.f) for r in got.collect()} == want and got.count() == len(want)
    assert {(r.lang, r.n) for r in sizes.collect() if r.n} == set(_counts(docs)[1].items())


def test_few_best_and_no_rows(spark):
    docs = _docs(3, 120)
    assert _rows(mine_phrases(_df(spark, docs), least=5, top=7)) == _brute(docs, 5, 7)
    assert mine_phrases(_df(spark, docs).limit(0)).collect() == []
    assert mine_phrases(_df(spark, [("en", None), (None, "")])).collect() == []


def test_long_texts_are_cut_where_a_piece_ends(monkeypatch):
    monkeypatch.setattr(phrases, "PIECE_BYTES", 100)
    rng = random.Random(4)
    text = "".join("".join(rng.choice("ab é") for _ in range(rng.randint(0, 150))) + rng.choice([", ", "\n"]) for _ in range(40)) + "z" * 300
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de"], "text": [text, "b"]})
    got = list(phrases._text_slices(iter([batch])))
    assert len(got) > 10 and b"".join(t[0].as_py() for _, t in got[:-1]).decode() == text
    assert all(t[0].as_py()[-1:] in b",\n" for _, t in got[:-2])


def test_texts_are_cut_into_words_once(spark):
    """Scans read packed lists, which say the same as the texts."""
    docs = [(lang or "und", text) for lang, text in _docs(5, 80)]
    ws = Workspace(spark, "t")
    count_phrases(_df(spark, docs), ws, 8, 2)
    lists = spark.read.parquet(f"{ws.path}/shards")
    assert set(lists.columns) == {*phrases._LISTS, "shard"}
    for lang, text in [zip(*docs, strict=True)]:
        batch = pa.RecordBatch.from_pydict({"lang": list(lang), "text": list(text)})
        packed = list(phrases._packing(2)(iter([batch.slice(0, 50), batch.slice(50)])))
    assert [b.column("shard")[0].as_py() for b in packed] == [0, 1]
    got, breaks = [], []
    for langs, sizes, words, places, follows, _ in phrases._unpacked_lists(iter(packed)):
        assert langs == list(lang[len(breaks) and 50 :])[: len(langs)] and sizes.sum() == len(places) == len(follows) - 1
        assert len(set(words.to_pylist())) == len(words)
        got += [w.decode() for w in words.take(pa.array(places)).to_pylist()]
        breaks += [not x for x in follows[:-1]]
    pieces = [w for _, text in docs for w in _pieces(text) if w]
    assert got == [x for w in pieces for x in w] and breaks == [k == 0 for w in pieces for k in range(len(w))]


def test_a_task_names_a_phrase_once():
    """However many lists it is in; and those that find no slot, again."""
    docs = pa.RecordBatch.from_pydict({"lang": ["en", "de"] * 30, "text": ["new york city", "new york"] * 30})
    packed = list(phrases._packing(1)(iter([docs.slice(k, 4) for k in range(0, 60, 4)])))
    table, bits = np.zeros(1 << phrases.SLOT_BITS, np.uint8), np.full(1 << phrases.FILTER_BITS - 3, 255, np.uint8)
    sent = [type("Sent", (), {"value": phrases.zlib.compress(x.tobytes(), 1)}) for x in (table, bits)]
    mask = np.uint64(2**64 - 128)
    rows = [r for b in phrases._naming(*sent, mask, True)(iter(packed)) for r in b.to_pylist()]
    want = {(lang, p) for lang in ("en", "de") for p in ("new", "york", "new york")} | {("en", p) for p in ("city", "york city", "new york city")}
    named = [(r["lang"], r["phrase"]) for r in rows if r["key"] is not None]
    assert len(named) == len(want) and set(named) == want
    assert {(r["lang"], r["f"]) for r in rows if r["key"] is None} == {("en", 90), ("de", 60)}
    every = [r for b in phrases._naming(*sent, mask, False)(iter(packed)) for r in b.to_pylist() if r["key"] is not None]
    assert len(every) == 30 * (6 + 3)
