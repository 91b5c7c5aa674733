import zlib
from collections import Counter

import numpy as np
import pytest

from tailwright.llm import quality_classifier as quality
from tailwright.llm import toxicity
from tailwright.llm.mixing import BUDGET, mix_documents, rake, thin
from tailwright.llm.quality_rules import Rules, clean, quality_rules, repeated_words

from .conftest import words


def test_line_rules():
    good = " ".join(words(3, 60)) + "."
    text = "\n".join([good, "home | about | contact |", "WOW!! SO!! GREAT!!", "All rights reserved.", good, "bare words", ""])
    out = clean(text.encode(), Rules())
    assert out[11].decode() == good + "\n" and out[8:11] == (2, 1, 2) and out[3] == 1
    assert clean(good.encode(), Rules())[5:7] == (False, True)
    assert clean(None, Rules())[:7] == (0, 0, 0, 0, 0, True, False)
    assert clean("é ü\n".encode(), Rules())[:2] == (2, 2)


def test_repeated_words_by_hand():
    assert repeated_words(b"a b c x a b c".split()) == 6
    assert repeated_words(b"a a a a".split()) == 4
    assert repeated_words(b"a b".split()) == repeated_words([]) == 0


def test_rules_on_odd_documents(odd_docs, no_docs):
    rows = quality_rules(odd_docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == odd_docs.count() and by[1].kept and not by[3].kept and by[7].n_words == 60_000
    assert quality_rules(no_docs).count() == 0


def test_raking_meets_all_marginals():
    rng = np.random.default_rng(0)
    cells = [(f"s{i}", f"l{j}", f"t{k}") for i in range(5) for j in range(3) for k in range(2)]
    tokens = rng.integers(1, 1000, len(cells)).astype(float)
    targets = {"source": {f"s{i}": i + 1 for i in range(5)}, "lang": {"l0": 0.5, "l1": 0.3, "l2": 0.2}, "topic": {"t0": 0.4, "t1": 0.6}}
    m = rake(cells, tokens, targets)
    weight = np.array([m.factors["source"][a] * m.factors["lang"][b] * m.factors["topic"][c] for a, b, c in cells]) * tokens
    share = lambda k, v: sum(w for c, w in zip(cells, weight, strict=True) if c[k] == v) / weight.sum()
    assert m.error < 1e-8 and abs(share(0, "s4") - 5 / 15) < 1e-6 and abs(share(1, "l1") - 0.3) < 1e-6 and abs(share(2, "t0") - 0.4) < 1e-6


def test_mixing_odd_documents(spark, odd_docs, no_docs):
    rows = mix_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(0 < r.probability <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[4].source == "unknown" and by[4].kept and by[3].probability == 1
    assert mix_documents(no_docs).count() == 0
    docs = spark.createDataFrame([(i, " ".join(words(i, 40)), "en", "hot" if i % 3 else f"s{i % 9}") for i in range(1500)], "doc_id long, text string, lang string, source string")
    kept = [r for r in mix_documents(docs, temper={"source": 0.5}).collect() if r.kept]
    goal = {s: n**0.5 for s, n in Counter("hot" if i % 3 else f"s{i % 9}" for i in range(1500)).items()}
    got = Counter()
    for r in kept:
        got[r.source] += r.n_tokens
    for s, g in goal.items():
        assert abs(got[s] / sum(got.values()) - g / sum(goal.values())) < 0.06


def test_values_beyond_the_common_ones_are_pooled(spark):
    """Three sources are common, three share '' with its own target; values without a target are not dropped."""
    sizes = {"a": 400, "b": 300, "c": 200, "d": 60, "e": 40, "": 20}
    docs = spark.createDataFrame([(i, " ".join(words(i, 30)), "en", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))], "doc_id long, text string, lang string, source string")
    temper = {"source": 0.7}
    rows = mix_documents(docs, temper=temper, most=3).collect()
    got, goal = Counter(), {s: (n / 1020) ** 0.7 for s, n in {"a": 400, "b": 300, "c": 200, "": 120}.items()}
    for r in rows:
        got[r.source] += r.n_tokens * r.probability
    assert len(rows) == 1020 and sum(r.kept for r in rows if r.source == "") > 60
    assert all(abs(got[s] / got.total() - g / sum(goal.values())) < 1e-6 for s, g in goal.items())
    # a given target holds for a rare value too, and others keep their weight
    rows = mix_documents(docs, {"source": {"a": 0.5, "e": 0.5}}, temper, most=3).collect()
    weights = {r.source: r.weight for r in rows}
    assert set(weights) == {"a", "b", "c", "e", ""} and weights["b"] == weights["c"] == weights[""] == 1
    got = Counter()
    for r in rows:
        got[r.source] += r.n_tokens * r.weight
    assert abs(got["a"] - got["e"]) < 1e-6 * got["a"] and {r.source for r in rows if r.kept} == set(weights)


def test_a_rare_value_does_not_set_the_rate_of_all(spark):
    langs = ["en"] * 900 + ["fr"] * 500 + ["de"] * 99 + [None]
    docs = spark.createDataFrame([(i, " ".join(words(i, 30)), x, "s") for i, x in enumerate(langs)], "doc_id long, text string, lang string, source string")
    rows = mix_documents(docs, temper={"lang": 0.3}).collect()
    kept = sum(r.n_tokens * r.probability for r in rows)
    assert abs(kept / sum(r.n_tokens for r in rows) - BUDGET) < 1e-6 and 0.54 < sum(r.kept for r in rows) / 1500 < 0.66
    assert all(r.probability == 1 for r in rows if r.lang in ("unknown", "de")) and len({r.probability for r in rows if r.lang == "en"}) == 1


def test_thinning_meets_what_can_be_met():
    rng = np.random.default_rng(4)
    cells = [(f"s{i}", f"l{j}") for i in range(6) for j in range(4)]
    tokens = rng.integers(500, 1500, len(cells)).astype(float)
    tokens[[c[1] == "l3" for c in cells]] = 1.0
    targets = {"source": {f"s{i}": 1.0 for i in range(6)}, "lang": {"l0": 0.4, "l1": 0.3, "l2": 0.2, "l3": 0.1}}
    m = thin(rake(cells, tokens, targets), cells, tokens, targets, 0.6)
    p = np.array([min(1.0, m.chances["source"][a] * m.chances["lang"][b]) for a, b in cells])
    share = lambda k, v: sum(x for c, x in zip(cells, p * tokens, strict=True) if c[k] == v) / (p * tokens).sum()
    assert abs((p * tokens).sum() / tokens.sum() - 0.6) < 1e-6 and abs(m.rate - 0.6) < 1e-6
    # l3 is kept whole and misses its share, which the other languages have in proportion; sources are even
    assert all(x == 1 for c, x in zip(cells, p, strict=True) if c[1] == "l3") and m.unmet["lang"]["l3"][0] == pytest.approx(0.1)
    assert m.unmet["lang"]["l3"][1] == pytest.approx(share(1, "l3")) and not m.unmet["source"]
    assert share(1, "l0") / share(1, "l2") == pytest.approx(2, abs=1e-5) and all(abs(share(0, f"s{i}") - 1 / 6) < 1e-6 for i in range(6))
    # where all shares can be met, weights over the largest one do it
    even = {"source": targets["source"]}
    one = [c[:1] for c in cells]
    m = thin(rake(one, tokens, even), one, tokens, even, 0.6)
    assert max(m.chances["source"].values()) == pytest.approx(1) and m.rate > 0.6 and not m.unmet["source"]


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = [], []
    for i in range(600):
        toxic, junk, lang = i % 4 == 0, i % 3 == 0, ("en", "fr")[i % 2]
        w = words(i, 80)
        if toxic:
            for k in range(5, 70, 12):
                w[k] = ("blaggard", "scoundreling", "nitwitted")[(i + k) % 3]
        if junk:
            w = [f"{x}$$$" for x in w]
        docs.append((i, " ".join(w), lang, "s"))
        labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def _held_out(scored, labels, label):
    truth = {r.doc_id: r[label] for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    return [(r.score, truth[r.doc_id]) for r in scored.collect() if r.doc_id in truth]


def test_toxicity_on_held_out_rows(labelled, odd_docs, no_docs):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    rows = _held_out(toxicity.score_toxicity(docs, model), labels, "toxic")
    assert np.mean([(s >= 0.5) == t for s, t in rows]) > 0.95
    odd = toxicity.score_toxicity(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score_toxicity(no_docs, model).count() == 0


def test_toxicity_learns_from_every_labelled_row(spark):
    """A mark that only one toxic text in some 60 has, and that in a text of over 64 KB, is learned; shards agree with their mean."""
    docs, labels, rare = [], [], []
    for i in range(6000):
        toxic, w = i % 2, words(i % 50, 12)
        odd = toxic and i % 60 == 1
        w[5] = ("quizzling" if odd else "blaggard") if toxic else w[5]
        learned = zlib.crc32(str(i).encode()) % 5 != 0
        if odd:
            rare.append(i)
        docs.append((i, " ".join(w + (words(7, 40) * 400 if odd and learned else []))))
        labels.append((i, toxic))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    fitted = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"), shard_rows=600)
    held = {r.doc_id: r.score for r in toxicity.score_toxicity(df, fitted).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert np.mean([(s >= 0.5) == i % 2 for i, s in held.items()]) > 0.98
    assert min(held[i] for i in rare if i in held) > 0.5


def test_thresholds_count_every_row(spark):
    rows = [(("a", "b")[i % 2], i % 4 // 2, 0.2 + 0.1 * (i % 2) + 0.4 * (i % 4 // 2)) for i in range(4000)] + [("c", 1, 0.05)]
    got = toxicity.calibrate(spark.createDataFrame(rows, "lang string, y int, score double"))
    assert set(got) == {None, "a", "b"}
    assert got["a"] == pytest.approx(0.4) and got["b"] == pytest.approx(0.5) and got[None] == pytest.approx(0.45)
    assert toxicity.calibrate(spark.createDataFrame([("a", 1, 0.5)], "lang string, y int, score double")) == {None: 0.5}


def test_the_folded_convolution_is_a_convolution():
    rng = np.random.default_rng(0)
    n = len(toxicity.WIDTHS) * toxicity.FILTERS
    m = toxicity.Model(rng.normal(size=(toxicity.BUCKETS, toxicity.DIM)), [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS], rng.normal(size=n), rng.normal(size=n), 0.3, {})
    m.emb[0] = 0
    texts = [b"alpha beta gamma", b"", None, b"beta"]
    got = toxicity.logits(m, m.folded(), texts, toxicity.Pieces())
    for t, g in zip(texts, got, strict=True):
        x = [m.emb[toxicity.pieces(w)].sum(axis=0) for w in (t or b"").split()] + [np.zeros(toxicity.DIM)] * max(toxicity.WIDTHS)
        pooled = []
        for w, f in zip(toxicity.WIDTHS, m.conv, strict=True):
            y = [sum(x[i + j] @ f[j] for j in range(w) if i + j < len(x)) for i in range(len(x) - max(toxicity.WIDTHS) + 1)]
            pooled.append(np.max(y, axis=0))
        assert abs(np.maximum(np.concatenate(pooled) + m.bias, 0) @ m.out + 0.3 - g) < 1e-3
    # a text's value does not rest on its neighbours
    alone = [toxicity.logits(m, m.folded(), [t], toxicity.Pieces())[0] for t in texts]
    assert np.allclose(alone, got, atol=1e-4)


def test_rules_of_quality_on_held_out_rows(labelled, odd_docs, no_docs):
    docs, labels = labelled
    ensemble = quality.fit(docs, labels)
    scored = quality.score_quality(docs, ensemble)
    rows = _held_out(scored, labels, "quality")
    assert np.mean([(s >= 0.3) == t for s, t in rows]) > 0.95
    # the compiled column is the ensemble
    for r in quality.with_statistics(docs).limit(20).join(scored, "doc_id").collect():
        x = np.array([[r[s] for s in quality.STATISTICS]])
        z = ensemble.bias + sum(w for rule, w in ensemble.rules if quality.holds(rule, x)[0]) + sum(np.clip(x[0, k], a, b) * w for k, a, b, w in ensemble.linear)
        assert abs(1 / (1 + np.exp(-z)) - r.score) < 1e-9
    odd = quality.score_quality(odd_docs, ensemble).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert quality.score_quality(no_docs, ensemble).count() == 0


def test_topics_are_subjects(spark):
    from tailwright.llm.common import Workspace
    from tailwright.llm.mixing import measured

    subjects = ["orbital telescope galaxies spectrum luminous", "sourdough fermentation kneading wholemeal bakeries", "goalkeeper midfielder penalties substitutes tournaments"]
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(rng.choice(subjects[i % 3].split(), 20)) + " the of and.", "en", "a") for i in range(120)] + [(200, None, None, None), (201, "short ones", "en", "a")]
    rows = measured(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), Workspace(spark, "t"), topics=3).collect()
    topic = {r.doc_id: r.topic for r in rows}
    assert topic[200] == topic[201] == "none" and len(rows) == 122
    assert [len({topic[i] for i in range(k, 120, 3)}) for k in range(3)] == [1, 1, 1] and len({topic[i] for i in range(3)}) == 3
