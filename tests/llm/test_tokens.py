import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tailwright.llm.common import Workspace
from tailwright.llm.packing import combinations, nnls, pack_documents, plan, slots
from tailwright.llm.token_files import read_tokens, write_tokens
from tailwright.llm.tokens import Encoder, default_path

FILES = {"byte_bpe_50k.json": False, "word_bpe_49k.json": True}


def _plain(name):
    return Tokenizer.from_file(default_path(name))


@pytest.fixture(scope="module")
def encoders():
    return {n: (Encoder(default_path(n), d), _plain(n)) for n, d in FILES.items()}


ODD = ["", " ", "  ", "a  b", "a   b", " a", "a ", "a \n b", "a\n\n b", "it's 's  x", "é́ ́a", "<|endoftext|> a<|endoftext|>", "a\t b", "ΑΣ Σ.", "日本 語　 x", "a\x1c b", "a\x01b \x01 c", "x\n\n", "İa b", "don't  I'LL", "hello <|endoftext|> world", "x <|ENDOFTEXT|>y <|startoftext|>", "<|endoftext|>"]


@pytest.mark.parametrize("name", FILES)
def test_odd_texts(encoders, name):
    ours, plain = encoders[name]
    assert [e.tolist() for e in ours.encode([*ODD, None])] == [plain.encode(t, add_special_tokens=False).ids for t in ODD] + [[]]


@pytest.mark.parametrize("name", FILES)
def test_names_of_special_tokens_as_text(name):
    plain = _plain(name)
    plain.encode_special_tokens = True
    assert [e.tolist() for e in Encoder(default_path(name), FILES[name], special_as_text=True).encode(ODD)] == [plain.encode(t, add_special_tokens=False).ids for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\tabAéÉ×—“'.!?0_9\x01Σİ́　€😀<|>"), max_size=30), max_size=4))
def test_any_text(encoders, texts):
    for ours, plain in encoders.values():
        assert [e.tolist() for e in ours.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_round_trip(spark, odd_docs):
    ws = Workspace(spark, "t")
    docs = odd_docs.repartition(3)
    total = write_tokens(docs, f"{ws.path}/ids", default_path("byte_bpe_50k.json"))
    rows = sorted(read_tokens(spark, f"{ws.path}/ids", with_ids=True).collect(), key=lambda r: r.start)
    plain, at = _plain("byte_bpe_50k.json"), 0
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is not None, i))
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    key = lambda x: (x[0] is not None, x)
    want = [(r.doc_id, plain.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in docs.collect()]
    assert sorted(((r.doc_id, list(r.ids)) for r in rows), key=key) == sorted(want, key=key)
    assert at == total


def test_forgetting_changes_no_ids(monkeypatch, encoders):
    from tailwright.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 6)
    ours, plain = Encoder(default_path("byte_bpe_50k.json"), False), encoders["byte_bpe_50k.json"][1]
    for t in ["a b c d e f g", "h i j a b", "long" * 40 + " a", "x y z " * 5, "a b c d e f g"]:
        assert ours.encode([t])[0].tolist() == plain.encode(t, add_special_tokens=False).ids
        assert len(ours.known) <= 6


def test_no_files(spark, no_docs):
    ws = Workspace(spark, "t")
    assert write_tokens(no_docs, f"{ws.path}/ids", default_path("byte_bpe_50k.json")) == 0
    assert read_tokens(spark, f"{ws.path}/ids").count() == 0


def test_packing_holds_every_id_once(spark, odd_docs):
    docs = odd_docs.where("doc_id is not null")
    rows = pack_documents(docs, default_path("word_bpe_49k.json"), window=256, with_ids=True).collect()
    plain = _plain("word_bpe_49k.json")
    want = sorted((r.doc_id, plain.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in docs.collect())
    got: dict = {}
    for r in rows:
        assert r.length == len(r.ids) <= 256 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        got.setdefault(r.doc_id, []).append((r.start, list(r.ids)))
    for i, pieces in got.items():
        own = [ids for d, ids in want if d == i]
        for ids in own:
            assert len(ids) in {s + len(p) for s, p in pieces}
        assert sorted(pieces) == sorted((s, ids[s : s + 256]) for ids in own for s in range(0, len(ids), 256))
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_tokens))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        end = 0
        for offset, length, total in sorted(parts):
            assert offset == end
            end += length
        assert end == total <= 256


def test_packing_nothing(no_docs):
    assert pack_documents(no_docs, default_path("word_bpe_49k.json")).count() == 0


def test_plan_uses_each_length_exactly():
    rng = np.random.default_rng(0)
    for scale in (1, 3, 400):
        hist = rng.integers(0, 2 * scale, 129) * (rng.random(129) < 0.7)
        hist[0] = 0
        strategies = plan(hist, 128)
        used = np.zeros(129, int)
        for lengths, times in strategies:
            assert sum(lengths) <= 128
            for v in lengths:
                used[v] += times
        assert used.tolist() == hist.tolist()
        table = slots(strategies)
        assert (np.diff(table["key"]) > 0).all()
    tokens, sequences = int((np.arange(129) * hist).sum()), sum(t for _, t in strategies)
    assert tokens / (128 * sequences) > 0.95


def test_least_squares_reach_the_histogram():
    combos = combinations(np.arange(1, 32), 32)
    truth = np.zeros(len(combos))
    truth[::7] = 20
    hist = np.zeros(33)
    for s, t in zip(combos, truth, strict=True):
        for v in s:
            hist[v] += t
    x = nnls(combos, hist, sweeps=300)
    made = np.zeros(33)
    for s, t in zip(combos, x, strict=True):
        for v in s:
            made[v] += t
    assert (x >= 0).all() and np.abs(made - hist)[1:].sum() < 0.05 * hist[1:].sum()
