"""The language-model scores against counting, and against a second coder that takes one decision at a time."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tailwright.llm import context_mixing as cm
from tailwright.llm.common import Workspace, fold, mix64
from tailwright.llm.context_mixing import END, Mixer, Tables, byte_code, fit_model, fit_words, log_probabilities, own_tables, score_documents, score_rows, text_vectors, with_beginnings
from tailwright.llm.texts import word_hash, words_of

from .conftest import words


def tokens(t):
    return [*(t or "").encode().lower().split(), END]


def learned(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 != 1


def test_bases_by_counting(spark, odd_docs, no_docs):
    docs = [(i, " ".join(words(i % 25, 60))) for i in range(120)] + [(200, None), (201, ""), (202, "Zzz zzz")] + [(5, "twice"), (5, "twice")]
    got = score_documents(spark.createDataFrame(docs, "doc_id long, text string"), bits=14).collect()
    c: Counter = Counter()
    for i, t in docs:
        if learned(i):
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), round(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in docs)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 and r.held_out == (not learned(r.doc_id)) for r in got)
    rows = score_documents(odd_docs, bits=14).collect()
    assert len(rows) == odd_docs.count()
    assert score_documents(no_docs, bits=14).count() == 0


def _stretch(x):
    return 1 / (1 + np.exp(-np.clip(x, -14, 14)))


def _coded(m: Mixer, x, gate):
    """One decision's probability of a one, from the mixer's numbers."""
    z = m.bias[gate] + sum(a * b for a, b in zip(x, m.weights[gate], strict=True))
    at = (np.clip(z, -11.99, 11.99) + 12) * (len(m.refine[0]) - 1) / 24
    low = int(at)
    r = (low + 1 - at) * m.refine[gate][low] + (at - low) * m.refine[gate][low + 1]
    return min(max(0.5 * _stretch(z) + 0.5 * r, 1e-7), 1 - 1e-7)


def _logit(pair):
    n = pair[0] + pair[1]
    return np.log((pair[1] + 0.02) / (pair[0] + 0.02)) * (n / (n + 0.4))


class Coder:
    """Codes texts decision by decision, with counts in dictionaries under whole contexts."""

    def __init__(self, model, docs):
        self.m = model
        self.open, self.word = Counter(), Counter()
        by_kind: Counter = Counter()
        for i, t in docs:
            if learned(i):
                kind = self.kind(t)
                for ctxs, b in self.firsts(t, kind):
                    self.put(self.open, ctxs, b, code=model.firsts)
                for w in tokens(t):
                    by_kind[w, kind] += 1
        for (w, kind), n in by_kind.items():
            for ctxs, b, _ in self.others(w, kind):
                self.put(self.word, [c for c in ctxs if c[0] == "whole"], b, n)
                self.put(self.word, [c for c in ctxs if c[0] == "kind"], b, n)
                self.put(self.word, [c for c in ctxs if isinstance(c[0], int)], b)

    def put(self, counts, ctxs, b, n=1, code=None):
        for node, bit in self.path(b, code):
            for c in ctxs:
                counts[c, node, bit] += n

    def path(self, b, code=None):
        code = code or self.m.code
        return [(int(code.node[b, d]), int(code.bit[b, d])) for d in range(code.length[b])]

    def kind(self, t):
        return int(self.m.kinds.of(text_vectors(*words_of(pa.array([(t or "").encode()], pa.binary()))))[0])

    def firsts(self, t, kind):
        before = END
        for w in tokens(t):
            tail = b"\0\0" if before == END else (b"\0" + before)[-2:]
            last = tail[1]
            slot = int(mix64(np.array([tail[0] << 8 | last], np.uint64))[0] >> np.uint64(64 - cm.LAST_BITS))
            seen = word_hash(before) % (1 << 64) >> (64 - cm.WORD_BITS)
            yield [(0,), (1, last), (2, slot), (3, seen), (4, kind), (5, kind, last)], w[0]
            before = w

    def others(self, w, kind):
        s = b"" if w == END else w
        s += END
        for k in range(1, len(s)):
            ctxs = [(o, s[max(0, k - o) : k] if o <= k else (b"^" + s[:k]), kind) for o in cm.ORDERS]
            yield [*ctxs, ("whole", s[:k]), ("kind", s[:k], kind)], s[k], k

    def score(self, t):
        kind = self.kind(t)
        total = np.log10(self.m.kinds.prior[kind])
        own, block, pending = Counter(), 0, Counter()
        for k, (ctxs, b) in enumerate(self.firsts(t, kind)):
            if k // cm.BLOCK != block:
                own.update(pending)
                pending, block = Counter(), k // cm.BLOCK
            for d, (node, bit) in enumerate(self.path(b, self.m.firsts)):
                pairs = [(self.open[c, node, 0], self.open[c, node, 1]) for c in ctxs]
                mine = (own[node, 0], own[node, 1])
                gate = min(d, 7) * 4 + (sum(pairs[3]) >= 3) * 2 + (sum(mine) >= 2)
                p = _coded(self.m.opening, [*map(_logit, pairs), _logit(mine)], gate)
                total += np.log10(p if bit else 1 - p)
                pending[node, bit] += 1
        for w in tokens(t):
            for ctxs, b, _ in self.others(w, kind):
                for d, (node, bit) in enumerate(self.path(b)):
                    pairs = [(self.word[c, node, 0], self.word[c, node, 1]) for c in ctxs]
                    n = [sum(x) for x in pairs]
                    few = lambda v: (v > 0) + (v > 3)
                    gate = ((min(int(np.log2(n[cm.WHOLE] + 1)), 7) * 3 + few(n[cm.KIND])) * 3 + few(n[cm.WHOLE - 1])) * 4 + int(cm._DEPTH[d])
                    p = _coded(self.m.mixer, list(map(_logit, pairs)), gate)
                    total += np.log10(p if bit else 1 - p)
        return total


def test_scores_against_one_decision_at_a_time(spark):
    docs = [(i, " ".join(words(i % 12, 30 + 7 * (i % 30)))) for i in range(40)] + [(90, None), (91, "Zqq zz!"), (92, " ".join(reversed(words(3, 200))))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = df.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), (fold() != 1).alias("learn"))
    model = fit_model(rows, bits=20, ws=Workspace(spark, "t"))
    coder = Coder(model, docs)
    got = {r.doc_id: r.score for r in score_rows(rows, model, head_words=40).collect()}  # other words are joined
    for i, t in docs:
        assert got[i] == pytest.approx(coder.score(t), rel=0.02), (i, t)  # own tables are hashed, and half full


def test_order_of_words_counts(spark):
    texts = [(i, " ".join(["one,", "two.", "three;"] * 60)) for i in range(30)] + [(100, " ".join(["three;", "two.", "one,"] * 60))]
    got = {r.doc_id: r.score for r in score_documents(spark.createDataFrame(texts, "doc_id long, text string"), bits=14).collect()}
    assert got[100] < got[1] - 10


def test_what_follows_a_first_byte_is_a_distribution():
    """Over all strings of a first byte and up to one more, and all longer ones together."""
    code = byte_code(np.bincount(np.frombuffer(b"aaabbc\n\n", np.uint8), minlength=256))
    assert sum(2.0 ** -code.length) == 1
    tables = Tables(code, 12)
    w, deep = [b"ab", b"a", b"", b"abc"], np.full(4, 6)
    times = np.array([[3, 1], [2, 0], [5, 5], [1, 0]])
    tables.add(w, times, deep, deep=False)
    m = fit_words(tables, w, times, deep)
    for kind in (0, 1):
        one = [b"a" + bytes([i]) for i in range(256) if i != 10]
        lp = 10 ** log_probabilities(m, tables, [b"a", *one], kind, np.full(256, 6))
        assert 0.2 < lp.sum() < 1.0001
        two = [b"ab" + bytes([i]) for i in range(256) if i != 10]
        more = 10 ** log_probabilities(m, tables, [b"ab", *two], kind, np.full(256, 6))
        assert more.sum() < 1.0001


def test_own_tables_follow_their_words():
    code = byte_code(np.ones(256, int))
    w, deep = [b"international", b"internationally", b"interval"], np.full(3, 6)
    times = np.ones((3, 4), np.int64)
    shared = Tables(code, 12)
    shared.add(w, times, deep, deep=False)
    tables = own_tables(code, shared.shared, 12, w, times, deep)
    seen, unseen = log_probabilities(Mixer.fresh(cm.WORD_GATES, cm.PREDICTORS), tables, [b"international", b"interxxtional"], 0, deep[:2])
    assert seen > unseen


def test_crowded_beginnings_are_split(spark):
    rows = [(f"https:{i}/page/{i}",) for i in range(40)] + [("x" * 200 + str(i),) for i in range(9)] + [("alone",)]
    out = with_beginnings(spark.createDataFrame(rows, "word string").select(F.col("word").cast("binary")), 5, Workspace(spark, "t")).collect()
    deep = {bytes(r.word).decode(): r.deep for r in out}
    assert len(deep) == 50 and deep["alone"] == 6 and deep["x" * 200 + "1"] == cm.NEVER
    crowds = Counter(w[:d] for w, d in deep.items() if d < cm.NEVER)
    assert max(crowds.values()) <= 5


def test_words_of_texts():
    texts = ["A bÉ c\n\td ", "", " \n", "x", None, "Ünï  codé"]
    got, at = words_of(pa.array([t if t is None else t.encode() for t in texts], pa.binary()))
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
    assert [got.to_pylist()[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] == [lower(t) for t in texts]


def test_scores_do_not_rest_on_how_texts_are_dealt(spark):
    rows = [(k, " ".join(words(k % 40, 30 + k % 50)) + f" w{k % 7}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for parts, shuffled in ((1, "4"), (7, "3")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
        got.append({r.doc_id: r for r in score_documents(docs.repartition(parts), bits=16).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    for k, r in got[0].items():
        assert got[1][k].score == pytest.approx(r.score, rel=1e-9) and got[1][k].base_score == pytest.approx(r.base_score, rel=1e-9)


def test_mixers_learn_from_all_texts_and_words(spark):
    """Every training text meets the mixer of first bytes, and every word of every kind that of words, as often as it occurs."""
    docs = [(i, " ".join([*words(i, 30), f"only{i}"])) for i in range(60)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", F.col("text").cast("binary").alias("text"), (fold() != 1).alias("learn"))
    m = fit_model(rows, bits=12, ws=Workspace(spark, "t"))
    decisions = sum(int(m.firsts.length[w[0]]) for i, t in docs if learned(i) for w in tokens(t))
    assert m.opening.seen == decisions
    assert m.mixer.seen == pytest.approx(_word_decisions(m), rel=1e-6)


def _word_decisions(m):
    """Of each distinct (word, kind) its decisions, weighted by its occurrences over the mean; by task as the words are dealt, here one."""
    total = 0.0
    got = [(b"" if r.word == END else bytes(r.word), [r[f"c{k}"] for k in range(len(m.kinds.prior))]) for r in m.counted.collect()]
    n, mass = sum(c > 0 for _, cs in got for c in cs), sum(sum(cs) for _, cs in got)
    for w, cs in got:
        total += sum(int(m.code.length[b]) for b in (w + END)[1:]) * sum(cs) * n / mass
    return total


def test_visits_take_all():
    mass = np.array([0, 1, 1, 3, 95, 0, 400.0])
    order, weight = cm.visits(mass, np.random.default_rng(0))
    assert set(order) == {1, 2, 3, 4, 6} and np.allclose(np.bincount(order, weight, 7), mass * 5 / 500) and weight.max() <= cm.VISIT
    assert len(cm.visits(np.zeros(3), np.random.default_rng(0))[0]) == 0


def _small_tables():
    w = sorted({b"%s%s" % (a, b) for a in (b"inter", b"internation", b"co", b"x") for b in (b"", b"al", b"ally", b"est", b"val")}) + [b""]
    code, deep = byte_code(np.ones(256, int)), np.full(len(w), 6)
    deep[w.index(b"internationest")] = 12  # a neighbour of other depth
    times = np.random.default_rng(0).integers(0, 4, (len(w), 4))
    shared = Tables(code, 12)
    shared.add(w, times, deep, deep=False)
    return own_tables(code, shared.shared, 12, w, times, deep), w, times, deep


def test_words_are_looked_up_for_many_batches_at_once(monkeypatch):
    """Learning is the same, and works out contexts once for some batches."""
    calls, contexts, got = [], cm.contexts, []
    monkeypatch.setattr(cm, "contexts", lambda *a: calls.append(1) or contexts(*a))
    tables, w, times, deep = _small_tables()
    for ahead in (1, 8):
        calls.clear()
        monkeypatch.setattr(cm, "AHEAD", ahead)
        got.append((fit_words(tables, w, times, deep, batch=8), len(calls)))
    n = len(cm.visits(times.astype(float).ravel(), np.random.default_rng(9))[0])
    assert [c for _, c in got] == [-(-n // 8), -(-n // 64)]
    a, b = got[0][0], got[1][0]
    assert a.seen == b.seen and np.array_equal(a.weights, b.weights) and np.array_equal(a.refine, b.refine) and np.abs(a.weights - 2 / cm.PREDICTORS).max() > 0


def test_beginnings_of_sorted_words_are_scored_once(monkeypatch):
    """The same values as of words by themselves, from fewer decisions."""
    tables, w, times, deep = _small_tables()
    m = fit_words(tables, w, times, deep)
    done, probability = [], Mixer.probability
    monkeypatch.setattr(Mixer, "probability", lambda self, x, gate: done.append(len(gate)) or probability(self, x, gate))
    for kind in range(4):
        alone = [log_probabilities(m, tables, [x], kind, deep[i : i + 1])[0] for i, x in enumerate(w)]
        every = sum(done)
        done.clear()
        assert np.allclose(log_probabilities(m, tables, w, kind, deep), alone, rtol=1e-6)
        assert np.allclose(log_probabilities(m, tables, w[::-1], kind, deep[::-1]), alone[::-1], rtol=1e-6)
        assert sum(done) / 2 < 0.7 * every
        done.clear()


def test_a_batch_of_words_is_learned_at_once(monkeypatch):
    """One call a batch, as long a step as its parts would take by themselves; counts of own tables are not worked out slot by slot."""
    tables, w, times, deep = _small_tables()
    calls, learn = [], Mixer.learn
    monkeypatch.setattr(Mixer, "learn", lambda self, x, gate, one, *a: calls.append(len(one)) or learn(self, x, gate, one, *a))
    m = fit_words(tables, w, times, deep, batch=8)
    n = len(cm.visits(times.astype(float).ravel(), np.random.default_rng(9))[0])
    assert len(calls) == -(-n // 8) and m.seen > 0
    for k in (500, 6000):  # few decisions and many
        rng = np.random.default_rng(k)
        x, gate, one, weight, part = rng.normal(size=(3, k)).astype(np.float32), rng.integers(0, 5, k), rng.random(k) < 0.3, rng.random(k), rng.integers(0, 4, k)
        whole, alone = Mixer.fresh(5, 3), [Mixer.fresh(5, 3) for _ in range(4)]
        first = whole.weights.copy()
        learn(whole, x, gate, one, 0.02, weight, part)
        for d, a in enumerate(alone):
            learn(a, x[:, part == d], gate[part == d], one[part == d], 0.02, weight[part == d])
        assert np.allclose(whole.weights - first, sum(a.weights - first for a in alone), atol=1e-6) and np.allclose(whole.bias, sum(a.bias for a in alone), atol=1e-6)
        assert whole.seen == pytest.approx(weight.sum())


def test_first_bytes_have_the_same_values_in_any_order():
    """Sorted by their bytes, decisions take fewer gathers; each word's value stays."""
    texts = pa.array([" ".join(words(i, 150 + 40 * i)).encode() for i in range(12)] + [b"", b"\xc3\xa9 z"], pa.binary())
    rng = np.random.default_rng(1)
    kinds = cm.Kinds(np.log(rng.dirichlet(np.ones(cm.BUCKETS), 4)), np.full(4, 0.25))
    code = byte_code(rng.integers(0, 99, 256))
    logits, seen = rng.normal(size=cm.CELLS).astype(np.float32), rng.random(cm.CELLS) < 0.5
    m = Mixer(rng.normal(size=(cm.OPEN_GATES, cm.OPENERS)), rng.normal(size=cm.OPEN_GATES), rng.random((cm.OPEN_GATES, cm.STEPS)))
    got = []
    for sort in (False, True):
        q = cm.Spoken(texts, kinds, code, sort=sort)
        p = np.ones(len(q.codes))
        for on, x, gate, one in cm.openings(q, logits, seen):
            p[on] *= np.where(one, m.probability(x, gate), 1 - m.probability(x, gate))
        got.append(p)
    assert np.array_equal(got[0][q.order], got[1]) and np.array_equal(np.sort(q.order), np.arange(len(q.order)))
