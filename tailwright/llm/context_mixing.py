"""Language-model scores by logistic context mixing over hashed-context bit predictors.

A text is coded word by word, each word spelled in bytes with an end mark (the end of the text is the empty word), each byte in
binary decisions along a prefix code. For each decision, several predictors look up counts of zeros and
ones under their context; their logits are combined by a weight vector that a gate selects, and the
result is refined by an adaptive map from (gate, probability) to what was seen.

The contexts of a word's first byte reach across words: the word before, its last bytes, the kind of
text, and what the text itself has shown so far. Those of its other bytes are the bytes before in the word and
the kind of text, so they are worked out once for each distinct word. Kinds of text are learned without labels.
"""

from __future__ import annotations

import heapq
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import BUCKETS, Kinds, learn_kinds
from .common import Workspace, fold, give_back, mix64, pieces
from .texts import PRIME as _PRIME
from .texts import powers as _powers
from .texts import word_hashes, words_of


END = b"\n"  # never inside a word
#: Bytes before, inside the word, that each predictor sees with the kind of text; then two that see the whole
#: beginning of the word, the second one together with the kind of text.
ORDERS = (1, 2, 3, 4)
PREDICTORS = len(ORDERS) + 2
WHOLE, KIND = len(ORDERS), len(ORDERS) + 1
#: Slots of a shared table. From some byte of a word on (its ``deep``), contexts of its beginning are counted in
#: tables of the words with the same beginning, which are sized by these words and live in their task.
TABLE_BITS = 20
#: Lengths of beginnings: the first one that at most ``LOCAL_WORDS`` / 2 words share is a word's own.
STEPS_DEEP = (6, 12, 24, 48, 96)
NEVER = 1 << 30
KINDS = 4
#: Distinct words whose bits one task adds up, and distinct words of one task with tables of its own.
TRAIN_WORDS = 300_000
LOCAL_WORDS = 30_000
#: Slots of an own table for each byte that it counts; some four decisions each.
OWN_SLOTS = 16
#: The mixer of first bytes learns from either half of the texts with counts of the other half; that of words from all words,
#: a visit for so many times a word's share of the occurrences.
HALVES = 2
VISIT = 4.0
AHEAD = 32  # batches of words that are looked up at once
#: Words, by occurrences, whose values are sent to all tasks; the others are joined.
HEAD_WORDS = 1 << 18
#: Bytes of texts that one shard's mixer learns from, in a fixed order; and shards whose mixers are averaged in one go.
SHARD_BYTES, GROUP_SHARDS = 8 << 20, 64
STEPS = 33  # of the refinement
CHUNK = 30_000  # bytes whose decisions are worked on at once

#: Bits of the hashed contexts of a first byte; each has 256 cells, one for each decision of the code.
LAST_BITS, WORD_BITS = 12, 13
PIECE = 2 << 20  # bytes of texts whose words are worked on at once
BLOCK = 128  # words after which a text's own counts are brought up to date
OPENERS = 7
_SIZES = [1, 256, 1 << LAST_BITS, 1 << WORD_BITS, KINDS, KINDS * 256]
_BASES = np.cumsum([0, *(s * 256 for s in _SIZES)])
CELLS = int(_BASES[-1])
_SEGMENT = 1 << 14

_NODE = np.uint64(0xD6E8FEB86659FD93)


def _packed(*values) -> bytes:
    """Model parts for a broadcast: tables are mostly zeros, and every node keeps a file of what is sent."""
    return zlib.compress(pickle.dumps(values, protocol=5), 1)


_OPEN: dict[tuple[int, int], tuple] = {}


def _opened(sent: bytes) -> tuple:
    """The parts again, unpacked once in a worker."""
    key = (len(sent), zlib.crc32(sent))
    if key not in _OPEN:
        _OPEN.clear()  # one at a time
        _OPEN[key] = pickle.loads(zlib.decompress(sent))
    return _OPEN[key]


# ---- the code of bytes


@dataclass
class Code:
    """A prefix code: by byte the number of decisions, and the node and the outcome of each."""

    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray

    def __post_init__(self):
        self.salt = np.ascontiguousarray(((self.node.astype(np.uint64) + np.uint64(1)) * _NODE).T)
        self.one = np.ascontiguousarray(self.bit.T)
        self.shortness = (self.node.shape[1] - self.length).astype(np.uint8)

    def step(self, d: int, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the node of each byte's decision d adds to its contexts, and the outcome."""
        return np.take(self.salt[d], f), np.take(self.one[d], f)


def byte_code(counts: np.ndarray) -> Code:
    """Huffman's code of the counts; bytes that never occur have codes, too, and no code is much longer than twelve."""
    heap = [(int(c) + int(counts.sum()) // 3000 + 1, b, b) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    for k in range(255):
        (n0, o0, a), (n1, o1, b) = heapq.heappop(heap), heapq.heappop(heap)
        inner = 256 + k
        parent[a], parent[b] = (inner, 0), (inner, 1)
        heapq.heappush(heap, (n0 + n1, min(o0, o1), inner))
    paths = []
    for b in range(256):
        path, at = [], b
        while at in parent:
            at, bit = parent[at]
            path.append((at - 256, bit))
        paths.append(path[::-1])
    most = max(map(len, paths))
    node, bit = np.zeros((256, most), np.uint8), np.zeros((256, most), bool)
    for b, path in enumerate(paths):
        for d, (n, x) in enumerate(path):
            node[b, d], bit[b, d] = n, x
    return Code(np.array([len(p) for p in paths]), node, bit)


# ---- mixing


@dataclass
class Mixer:
    weights: np.ndarray  # gate x predictor
    bias: np.ndarray  # gate
    refine: np.ndarray  # gate x step, probabilities
    seen: float = 0.0  # decisions learned from

    @staticmethod
    def fresh(gates: int, predictors: int) -> Mixer:
        first = np.tile(1 / (1 + np.exp(-np.linspace(-12, 12, STEPS))), (gates, 1))
        return Mixer(np.full((gates, predictors), 2.0 / predictors), np.zeros(gates), first)

    def raw(self, x: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.take(self.bias.astype(np.float32), gate)
        by_predictor = np.ascontiguousarray(self.weights.T, np.float32)
        if len(z) < 4096:
            for term in x * np.take(by_predictor, gate, axis=1):
                z += term
        else:
            for k in range(len(x)):
                z += x[k] * np.take(by_predictor[k], gate)
        p = np.maximum(np.minimum(z, np.float32(14)), np.float32(-14))
        np.exp(np.negative(p, out=p), out=p)
        p += 1
        return z, np.reciprocal(p, out=p)

    @staticmethod
    def steps(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lower step of the adaptive map, and how far beyond it z lies."""
        x = (np.maximum(np.minimum(z, np.float32(11.99)), np.float32(-11.99)) + 12) * ((STEPS - 1) / 24)
        low = x.astype(np.int64)
        return low, x - low.astype(np.float32)

    def refined(self, gate: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Interpolated entries of the adaptive map."""
        low, part = self.steps(z)
        cell, flat = gate * STEPS + low, self.refine.ravel()
        below = np.take(flat, cell)
        return below + part * (np.take(flat, cell + 1) - below)

    def probability(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Of a one."""
        z, p = self.raw(x, gate)
        return np.clip(0.5 * p + 0.5 * self.refined(gate, z), 1e-7, 1 - 1e-7)

    def learn(self, x: np.ndarray, gate: np.ndarray, one: np.ndarray, rate: float, weight: np.ndarray | None = None, part: np.ndarray | None = None) -> None:
        """A step down the slope of the code length, and of the map towards what was seen; weight: of each decision, one if not given.

        part: of decisions that are of several parts; the step is then the sum of those that the parts would take by themselves.
        """
        g, p = len(self.bias), len(x)
        z, guess = self.raw(x, gate)
        err = one - guess if weight is None else (one - guess) * weight
        if part is None:
            scale = rate / np.sqrt(np.maximum(np.bincount(gate, weight, g), 1))
        else:
            key, scale = part * g + gate, 1.0
            err *= np.take(rate / np.sqrt(np.maximum(np.bincount(key, weight), 1)), key)
        if len(one) < 4096:  # few decisions cost a call each rather than their sums
            terms = np.empty((p + 1, len(one)))
            np.multiply(x, err, out=terms[:p])
            terms[p] = err
            sums = np.bincount((gate + np.arange(0, (p + 1) * g, g)[:, None]).ravel(), terms.ravel(), (p + 1) * g).reshape(p + 1, g)
            sums *= scale
            self.weights += sums[:p].T
            self.bias += sums[p]
        else:
            for k in range(p):
                self.weights[:, k] += scale * np.bincount(gate, err * x[k], g)
            self.bias += scale * np.bincount(gate, err, g)
        # by gate, step and outcome: all that fell there, and what of it belongs to the step above
        low, beyond = self.steps(z)
        cell = (gate * STEPS + low) * 2 + one
        both = np.bincount(cell, weight, 2 * g * STEPS).astype(float).reshape(g, STEPS, 2)
        above = np.bincount(cell, beyond if weight is None else beyond * weight, 2 * g * STEPS).reshape(g, STEPS, 2)
        both -= above
        both[:, 1:] += above[:, :-1]
        hit, ones = both[:, :, 0] + both[:, :, 1], both[:, :, 1]
        self.refine += (ones - hit * self.refine) / (hit + 200.0)
        self.seen += len(one) if weight is None else float(weight.sum())

    def packed(self) -> bytes:
        return np.concatenate([self.weights.ravel(), self.bias, self.refine.ravel()]).tobytes()

    @staticmethod
    def average(rows: list[tuple[bytes, float]], gates: int, predictors: int) -> Mixer:
        """The mean of mixers, each by the decisions that it has learned from."""
        out, total = Mixer.fresh(gates, predictors), sum(s for _, s in rows)
        if total:
            mean = sum(np.frombuffer(b) * (s / total) for b, s in rows)
            a, b = gates * predictors, gates * (predictors + 1)
            out = Mixer(mean[:a].reshape(gates, predictors), mean[a:b], mean[b:].reshape(gates, STEPS), total)
        return out


def _input(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """A predictor's logits, shrunk where it has seen little."""
    n = zeros + ones
    x = ones + np.float32(0.02)
    x /= zeros + np.float32(0.02)
    np.log(x, out=x)
    x *= n
    n += np.float32(0.4)
    x /= n
    return x


# ---- words: the bytes after the first one


def _offsets(words: pa.Array) -> np.ndarray:
    return np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)


def _array(words: pa.Array | list[bytes]) -> pa.Array:
    return words if isinstance(words, pa.Array) else pa.array(words, pa.binary())


def spelled(words: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes with end marks in a row, the word of each, and its place in the word."""
    words = _array(words)
    at = _offsets(words)
    lengths = np.diff(at) + 1
    ends = np.cumsum(lengths)
    flat = np.full(int(lengths.sum()), END[0], np.uint8)
    inner = np.ones(len(flat), bool)
    inner[ends - 1] = False
    if at[-1] > at[0]:
        flat[inner] = np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]]
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(flat)) - np.repeat(ends - lengths, lengths)
    return flat, word, place


def contexts(flat: np.ndarray, place: np.ndarray) -> np.ndarray:
    """One 64-bit hash per predictor and byte, of the bytes before it in the word (without the kind)."""
    n = len(flat)
    out = np.zeros((PREDICTORS, n), np.uint64)
    ctx = np.zeros(n, np.uint64)
    b = flat.astype(np.uint64) + np.uint64(1)
    for k in range(1, max(ORDERS) + 1):
        step = np.zeros(n, np.uint64)
        step[k:] = b[:-k]
        step[place < k] = 0
        ctx = ctx * _PRIME + step
        if k in ORDERS:
            out[ORDERS.index(k)] = ctx
    # the whole beginning: a running sum whose words before are taken out
    run = np.cumsum(mix64(b) * _powers(int(place.max(initial=0)) + 2)[place], dtype=np.uint64)
    before = np.concatenate([[np.uint64(0)], run[:-1]])
    first = np.flatnonzero(place == 0)
    out[WHOLE] = out[KIND] = before - np.repeat(before[first], np.diff(np.append(first, n)))
    return mix64(out + np.arange(1, PREDICTORS + 1, dtype=np.uint64)[:, None] * _PRIME)


def of_kind(ctx: np.ndarray, kind) -> np.ndarray:
    return mix64(ctx + (np.atleast_1d(np.asarray(kind, np.uint64)) + np.uint64(1)) * _NODE)


def cell_hash(ctx: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A hash of each context and the node of its decision."""
    h = ctx ^ salt
    h *= _PRIME
    return h


def slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).view(np.int64)


_FROZEN: dict = {}  # of the shared tables that a worker scores with


class Tables:
    """Counts of (zeros, ones): shared ones for all predictors, own ones for deep contexts."""

    def __init__(self, code: Code, bits: int, shared: np.ndarray | None = None, deep_bytes: int = 0):
        self.code, self.bits = code, bits
        self.shared = np.zeros((PREDICTORS, 2 << bits), np.float32) if shared is None else shared
        self.own_bits = max(8, int(np.ceil(np.log2(OWN_SLOTS * deep_bytes + 1)))) if deep_bytes else 0
        self.own = np.zeros((2, 2 << self.own_bits), np.float32) if deep_bytes else None

    def add(self, words: pa.Array | list[bytes], times: np.ndarray, deep_at: np.ndarray, deep: bool) -> None:
        """Count every decision of the words but their first bytes', in the shared tables or (deep) the own ones. times: word x kind."""
        code = self.code
        for flat, word, place in _stretches(words, 4 * CHUNK):
            ctx = contexts(flat, place)
            here = place >= deep_at[word]
            rest = place > 0
            for predictors in ((WHOLE,), (KIND,)) if deep else (range(WHOLE), (WHOLE,), (KIND,)):
                at = np.flatnonzero(here & rest if deep else (rest if predictors[0] < WHOLE else rest & ~here))
                # bytes of long codes first: those that have a step of the code are the first so many
                at = at[_long_first(code, flat[at])]
                # the words by kind, all kinds' in a row, or once for all kinds
                if WHOLE in predictors:
                    shares = [(None, times.sum(axis=1))]
                else:
                    shares = list(enumerate(times.T))
                for kind, share in shares:
                    w = np.take(share, np.take(word, at))
                    live = at
                    if not w.all():
                        some = np.flatnonzero(w)
                        live, w = at[some], w[some]
                    if not len(live):
                        continue
                    if WHOLE not in predictors and KIND not in predictors:
                        w = np.minimum(w, 1)  # each word once: short contexts speak for words not seen
                    f, w = np.take(flat, live), w.astype(np.float32)
                    steps = [(n, *code.step(d, f[:n])) for d, n in _steps(code, f)]
                    for p in predictors:
                        c = np.take(ctx[p], live)
                        if kind is not None:
                            c = of_kind(c, kind)
                        table, bits = (self.own[p - WHOLE], self.own_bits) if deep else (self.shared[p], self.bits)
                        for n, salt, one in steps:
                            at_slot = slot(cell_hash(c[:n], salt), bits)
                            at_slot <<= 1
                            at_slot += one
                            np.add.at(table, at_slot, w[:n])

    def freeze(self) -> None:
        """Work out all logits and parts of gates of the shared tables once, for scoring."""
        if _FROZEN.get("of") is not self.shared:
            pair = lambda t: (t[0::2], t[1::2])
            _FROZEN.update(of=self.shared, logits=np.stack([_input(*pair(t)) for t in self.shared]), gates={p: gate_part(p, sum(pair(self.shared[p]))) for p in GATED})
        self.logits, self.gates = _FROZEN["logits"], _FROZEN["gates"]

    def frozen(self, p: int, h: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Logits of each context (by its hash with the node) and its part of the gate, if it has one; own: the own tables count."""
        if own and p >= WHOLE:  # few of their slots are asked for
            zeros, ones = self.look(p, h, own)
            return _input(zeros, ones), gate_part(p, zeros + ones)
        s = slot(h, self.bits)
        return np.take(self.logits[p], s), np.take(self.gates[p], s) if p in self.gates else None

    def look(self, p: int, h: np.ndarray, own: bool, out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Zeros and ones seen in each context (by its hash with the node); own: the own tables count; out: what is taken out of the counts, zeros and ones as one value."""
        # both counts of a slot as one value, so that it is visited once
        if not (own and p >= WHOLE):
            seen = np.take(self.shared[p].view(np.complex64), slot(h, self.bits))
        elif self.own is None:
            seen = np.zeros(len(h), np.complex64)
        else:
            seen = np.take(self.own[p - WHOLE].view(np.complex64), slot(h, self.own_bits))
        if out is not None:
            seen -= out
            both = seen.view(np.float32)
            np.maximum(both, 0, out=both)
        return seen.real, seen.imag


def _long_first(code: Code, f: np.ndarray) -> np.ndarray:
    """The order of bytes by the length of their codes, the longest ones first."""
    return np.argsort(np.take(code.shortness, f), kind="stable")


def _steps(code: Code, f: np.ndarray) -> Iterator[tuple[int, int]]:
    """For each step of the code, how many of the bytes have it. f: the longest codes first."""
    sizes = np.bincount(np.take(code.length, f), minlength=code.node.shape[1] + 1)
    for d, n in enumerate((len(f) - np.cumsum(sizes))[:-1].tolist()):
        if n:
            yield d, n


def _stretches(words: pa.Array | list[bytes], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Spelled words, so many at once that they have about ``most`` bytes; words numbered over all."""
    words = _array(words)
    at = _offsets(words)
    ends = at[1:] - at[0] + np.arange(1, len(at))
    start = 0
    while start < len(words):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most)))
        flat, word, place = spelled(words.slice(start, end - start))
        yield flat, word + start, place
        start = end


#: Gates: how often the beginning of the word has been seen (by powers of two), how often in the kind of text, and the
#: last four bytes, and how far the code is.
WORD_GATES = 8 * 3 * 3 * 4
GATED = (WHOLE, KIND, WHOLE - 1)
_DEPTH = np.array([0, 1, 1, 2, 2, 2] + [3] * 300)
_ONCE = np.array([1, 1j], np.complex64)  # one zero, one one


def gate_part(p: int, seen: np.ndarray) -> np.ndarray:
    """What a predictor adds to the gate, by how often its context has been seen."""
    if p == WHOLE:
        return np.minimum(np.log2(seen + 1).astype(np.int16), 7) * np.int16(36)
    return ((seen > 0).astype(np.int16) + (seen > 3)) * np.int16(12 if p == KIND else 4)


def _decisions(tables: Tables, flat: np.ndarray, word: np.ndarray, place: np.ndarray, kind, deep_at: np.ndarray, lone: np.ndarray | None = None, but: np.ndarray | None = None):
    """For bytes that shared tables tell all of, and then those that own ones tell of, each step of the code: its number, which bytes (without ``but``) have it, inputs, gates and outcomes.

    lone: take one occurrence of each word out of the counts, and of words that are so all there is of them.
    """
    every = contexts(flat, place)
    here = place >= deep_at[word]
    code = tables.code
    rest = place > 0 if but is None else (place > 0) & ~but
    for own in (False, True):
        at = np.flatnonzero(rest & here if own else rest & ~here)
        if not len(at):
            continue
        if lone is None:  # those that have a step are the first so many
            at = at[_long_first(code, flat[at])]
        f = flat[at]
        ctx = [np.take(c, at) for c in every]
        k = np.take(kind, at) if np.ndim(kind) else kind
        ctx = [c if p == WHOLE else of_kind(c, k) for p, c in enumerate(ctx)]
        if lone is None:
            steps = ((d, slice(0, n)) for d, n in _steps(code, f))
        else:
            length = code.length[f]
            least = int(length.min())
            steps = ((d, slice(None) if d < least else np.flatnonzero(length > d)) for d in range(int(length.max())))
            only = lone[word[at]].astype(np.float32)
        for d, on in steps:
            salt, one = code.step(d, f[on])
            x, gates = np.empty((PREDICTORS, len(one)), np.float32), np.full(len(one), _DEPTH[d])
            if lone is not None:
                out = _ONCE[one.view(np.uint8)]
                short_out = out * only[on]
            for p in range(PREDICTORS):
                h = cell_hash(ctx[p][on], salt)
                if lone is None:
                    x[p], gate = tables.frozen(p, h, own)
                else:
                    zeros, ones = tables.look(p, h, own, short_out if p < WHOLE else out)
                    x[p] = _input(zeros, ones)
                    gate = gate_part(p, zeros + ones) if p in GATED else None
                if gate is not None:
                    gates += gate
            yield d, at[on], x, gates, one


def _as_before(flat: np.ndarray, word: np.ndarray, place: np.ndarray, deep_at: np.ndarray) -> np.ndarray:
    """Bytes up to which a word is equal to the one before it: sorted words share beginnings, which have one value."""
    sizes = np.bincount(word - word[0])
    ahead = np.append(0, sizes[:-1])
    w = word - word[0]
    equal = (place < ahead[w]) & (flat == flat[np.arange(len(flat)) - ahead[w]])
    equal &= deep_at[word] == deep_at[np.maximum(word - 1, word[0])]
    differ = np.cumsum(~equal)
    starts = np.cumsum(sizes) - sizes
    return differ - (differ[starts] - ~equal[starts])[w] == 0


def log_probabilities(m: Mixer, tables: Tables, words: pa.Array | list[bytes], kind: int, deep_at: np.ndarray) -> np.ndarray:
    """log10 probability of what follows each word's first byte, in a text of the kind."""
    out = np.zeros(len(words))
    if not hasattr(tables, "logits"):
        tables.freeze()
    for flat, word, place in _stretches(words, CHUNK):
        total = np.zeros(len(flat))
        shared = _as_before(flat, word, place, deep_at)
        for _, on, x, gate, one in _decisions(tables, flat, word, place, kind, deep_at, but=shared):
            p = m.probability(x, gate)
            total[on] += np.log10(np.where(one, p, 1 - p))
        # a beginning has the value that it has in the word before
        by_place = np.argsort(place.astype(np.uint16) if place.max() < 1 << 16 else place, kind="stable")
        total[by_place] = total[by_place][np.maximum.accumulate(np.where(shared[by_place], 0, np.arange(len(flat))))]
        first, last = int(word[0]), int(word[-1]) + 1
        out[first:last] = np.bincount(word - first, total, last - first)
    return out


def visits(mass: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """All entries with a mass in a mixed order, each at least once, and the weight of each visit: in all, an entry's weight is in proportion to its mass."""
    weight = mass * ((mass > 0).sum() / max(mass.sum(), 1.0))
    times = np.ceil(weight / VISIT).astype(np.int64)
    order = rng.permutation(np.repeat(np.arange(len(mass)), times))
    return order, weight[order] / times[order]


def fit_words(tables: Tables, words: pa.Array | list[bytes], times: np.ndarray, deep_at: np.ndarray, batch: int = 256, rate: float = 0.02, seed: int = 9) -> Mixer:
    """Learn the mixer online, a batch of words after another, from all words with a count, each weighted by its occurrences.

    Each occurrence is predicted from counts without itself, so that words seen once stand for
    words not seen. times: word x kind.
    """
    m = Mixer.fresh(WORD_GATES, PREDICTORS)
    words = _array(words)
    mass = times.astype(float).ravel()
    order, weights = visits(mass, np.random.default_rng(seed))
    kinds = times.shape[1]
    # what is mixed does not depend on the mixer: it is looked up for some batches at once
    for start in range(0, len(order), batch * AHEAD):
        some, weight = order[start : start + batch * AHEAD], weights[start : start + batch * AHEAD]
        at = some // kinds
        flat, word, place = spelled(words.take(pa.array(at)))
        ends = np.searchsorted(word, np.arange(batch, len(some) + batch, batch))
        steps, cuts = [], []
        for d, on, x, gate, one in _decisions(tables, flat, word, place, (some % kinds)[word], deep_at[at], mass[some] == 1):
            steps.append((x, gate, one, weight[word[on]], np.full(len(on), d)))
            cuts.append([0, *np.searchsorted(on, ends).tolist()])
        if not steps:
            continue
        for b in range(len(ends)):
            # all decisions of a batch at once, those of each step of the code as a part of their own
            x, gate, one, w, step = (np.concatenate([part[..., c[b] : c[b + 1]] for part, c in zip(parts, cuts, strict=True)], axis=-1) for parts in zip(*steps, strict=True))
            if len(one):
                m.learn(x, gate, one, rate / (1 + 3 * (start + b * batch) / len(order)), w, step)
    return m


# ---- texts: words in a row


def short_buckets(words: pa.Array) -> np.ndarray:
    """The bucket of each word of up to four bytes, -1 for longer ones."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1]
    data = np.concatenate([np.frombuffer(words.buffers()[2], np.uint8), np.zeros(4, np.uint8)]) if len(words) else np.zeros(4, np.uint8)
    start, size = offsets[:-1].astype(np.int64), np.diff(offsets)
    key = np.zeros(len(words), np.uint64)
    for k in range(4):
        key |= np.where(size > k, data[np.minimum(start + k, len(data) - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0)) << np.uint64(16 * k)
    return np.where(size <= 4, (mix64(key) % np.uint64(BUCKETS)).astype(np.int64), -1)


def text_vectors(words: pa.Array, at: np.ndarray) -> np.ndarray:
    """Text x bucket: its short words."""
    return bucket_counts(short_buckets(words), at)


def bucket_counts(bucket: np.ndarray, at: np.ndarray) -> np.ndarray:
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ok = bucket >= 0
    return np.bincount(text[ok] * BUCKETS + bucket[ok], minlength=(len(at) - 1) * BUCKETS).reshape(-1, BUCKETS)


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of training texts, and one row of byte counts: of their words' first bytes, and of the others with end marks."""
    total = np.zeros((2, 256), np.int64)
    for b in pieces(batches, rows=1000, size=PIECE):
        words, at = words_of(b.column("text"))
        if len(words):
            data = np.frombuffer(words.buffers()[2], np.uint8)
            first = np.bincount(data[np.frombuffer(words.buffers()[1], np.int32)[: len(words)]], minlength=256)
            total += np.stack([first, np.bincount(data, minlength=256) - first])
        total[:, END[0]] += (b.num_rows, len(words))
        x = np.minimum(text_vectors(words, at), 65535).astype("<u2")
        yield pa.RecordBatch.from_pydict({"vector": [v.tobytes() for v in x], "bytes": pa.nulls(len(x), pa.binary())})
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["vector", "bytes"])


def _byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x in b.column("bytes").to_pylist():
            yield pa.RecordBatch.from_pydict({"at": np.arange(512, dtype=np.int32), "n": np.frombuffer(x, np.int64)})


class Spoken:
    """A batch of texts as codes of distinct words, with an end behind each text. Without a code their first bytes are not taken apart into decisions.

    sort: decisions are held in the order of the first bytes, the longest codes first (``order`` has their words), not of the text.
    """

    def __init__(self, texts: pa.Array, kinds: Kinds, code: Code | None = None, sort: bool = False):
        words, at = words_of(texts)
        self.n = len(at) - 1
        coded = words.dictionary_encode()
        self.distinct = coded.dictionary
        codes = coded.indices.to_numpy()
        # by einsum: a small product, for which the threads of a matrix library would only wait, and a text's sums are the same in any batch
        self.kind = (np.einsum("ij,kj->ik", bucket_counts(short_buckets(self.distinct)[codes], at).astype(float), kinds.logs) + np.log(kinds.prior)).argmax(axis=1)
        end = len(self.distinct)
        self.codes = np.insert(codes, at[1:], end)
        self.at = at + np.arange(self.n + 1)
        self.text = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.at))
        self.hash = word_hashes(pa.concat_arrays([self.distinct, pa.array([END], pa.binary())]))
        offsets = np.frombuffer(self.distinct.buffers()[1], np.int32)[: end + 1].astype(np.int64) if end else np.zeros(1, np.int64)
        data = np.frombuffer(self.distinct.buffers()[2], np.uint8) if end else np.zeros(0, np.uint8)
        first = np.append(data[offsets[:-1]], np.uint8(END[0]))
        last = np.append(data[offsets[1:] - 1], np.uint8(0)).astype(np.int32)
        last2 = np.append(np.where(np.diff(offsets) > 1, data[np.maximum(offsets[1:] - 2, 0)], 0), 0).astype(np.int32)
        tail = (mix64((last2 << 8 | last).astype(np.uint64)) >> np.uint64(64 - LAST_BITS)).astype(np.int32)
        word = (self.hash >> np.uint64(64 - WORD_BITS)).astype(np.int32)
        # the word before; ahead of the first one there is none, which is coded like the end
        prev = np.empty_like(self.codes)
        prev[1:] = self.codes[:-1]
        prev[self.at[:-1]] = end
        kind = (self.kind.astype(np.int32) * 256)[self.text]
        last = last[prev]
        rows = [None, last, tail[prev], word[prev], kind >> 8, kind + last]
        self.cells = [b if r is None else (r << 8) + np.int32(b) for r, b in zip(rows, _BASES[:-1].tolist(), strict=True)]
        self.first = f = first[self.codes]
        if code is None:
            return
        # the text's own decisions up to the block before
        place = np.arange(len(self.first), dtype=np.int32) - self.at[:-1].astype(np.int32)[self.text]
        sizes = -(-np.diff(self.at) // BLOCK)
        base = np.cumsum(sizes) - sizes
        self.block = (base.astype(np.int32)[self.text] + place // BLOCK) << 8
        if sort:  # what is looked up together lies together, and those that have a step are the first so many
            self.order = np.argsort(np.lexsort((np.arange(256), code.shortness)).argsort().astype(np.uint8)[f], kind="stable")
            f, self.block = np.take(f, self.order), np.take(self.block, self.order)
            self.cells = [c if isinstance(c, int) else np.take(c, self.order) for c in self.cells]
        # all decisions, step by step of the code: which words have it, the node and the outcome
        on = None  # all
        steps, self.ons = [], []
        for d in range(code.node.shape[1]):
            live = (code.length > d)[f]
            if not live.all():
                live = np.flatnonzero(live)
                on = live.astype(np.int32) if on is None else on[live]
                f = f[live]
            if not len(f):
                break
            self.ons.append(on if on is not None and not sort else slice(0, len(f)))
            steps.append((code.node[:, d].copy()[f], code.bit[:, d].copy()[f]))
        self.ends = np.cumsum([0, *(len(node) for node, _ in steps)]).tolist()
        self.node, self.bit = (np.concatenate(x) for x in zip(*steps, strict=True))
        n = int(sizes.sum())
        at_own = np.concatenate([self.block[on] for on in self.ons])
        at_own += self.node
        at_own <<= 1
        at_own += self.bit
        own = np.bincount(at_own, minlength=n * 512).astype(np.float32)
        run, begins = own.reshape(n, 512), np.zeros(n, bool)
        begins[base] = True
        held = np.zeros(512, np.float32)
        for row, new in zip(run, begins.tolist(), strict=True):
            if new:
                held[:] = 0
            held += row
            np.subtract(held, row, out=row)
        self.own = run.reshape(-1, 2)

    def places(self, p: int, on: np.ndarray | slice) -> np.ndarray | int:
        """Cells of a predictor, less the node."""
        return self.cells[p] if isinstance(self.cells[p], int) else self.cells[p][on]


#: Gates: how far the code is, whether the word before has been seen here, and whether the text itself has shown something.
OPEN_GATES = 8 * 2 * 2


def opening_inputs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits of all cells, and which ones have been seen three times. counts: cell x (zeros, ones)."""
    logits, seen = np.empty(len(counts), np.float32), np.empty(len(counts), bool)
    for s in range(0, len(counts), 1 << 17):
        part = counts[s : s + (1 << 17)].astype(np.float32)
        logits[s : s + (1 << 17)] = _input(part[:, 0], part[:, 1])
        seen[s : s + (1 << 17)] = part.sum(axis=1) >= 3
    return logits, seen


def openings(q: Spoken, logits: np.ndarray, seen: np.ndarray):
    """For each step of the code of first bytes: which words have it, inputs, gates and outcomes."""
    own, shown = _input(q.own[:, 0], q.own[:, 1]).astype(np.float32), q.own[:, 0] + q.own[:, 1] >= 2
    for d, (low, high, all_on) in enumerate(zip(q.ends[:-1], q.ends[1:], q.ons, strict=True)):
        for s in range(low, high, 1 << 15):
            e = min(s + (1 << 15), high)
            on, node = slice(s - low, e - low) if isinstance(all_on, slice) else all_on[s - low : e - low].astype(np.intp), q.node[s:e]
            x = np.empty((OPENERS, e - s), np.float32)
            at = [q.places(p, on) + node for p in range(OPENERS - 1)]
            for p in range(OPENERS - 1):
                np.take(logits, at[p], out=x[p], mode="clip")
            mine = q.block[on] + node
            np.take(own, mine, out=x[-1], mode="clip")
            yield on, x, min(d, 7) * 4 + np.take(seen, at[3]) * 2 + np.take(shown, mine), q.bit[s:e]


def _opening_cells(q: Spoken, pairs: np.ndarray, chosen: np.ndarray) -> None:
    """Add the chosen words' first bytes to the counts of (context, byte)."""
    on = np.flatnonzero(chosen)
    first = q.first[on].astype(np.int32)
    one = np.ones(len(on), pairs.dtype)  # of the table's own type, which is much quicker
    for p, (low, high) in enumerate(zip(_BASES[:-1].tolist(), _BASES[1:].tolist(), strict=True)):
        at = q.places(p, on) - low + first
        if high - low > len(on):
            np.add.at(pairs[low:high], at.astype(np.intp), one)
        else:
            pairs[low:high] += np.bincount(at, minlength=high - low)


def opening_counts(pairs: np.ndarray, code: Code) -> np.ndarray:
    """Cell x (zeros, ones): the decisions that bytes take in their contexts. pairs: counts of (context, byte)."""
    taken = np.zeros((256, 256, 2))
    for d in range(code.node.shape[1]):
        on = np.flatnonzero(code.length > d)
        taken[on, code.node[on, d], code.bit[on, d].astype(int)] = 1
    rows = pairs.reshape(-1, 256)
    out = np.empty((len(rows), 512), np.float32)
    for s in range(0, len(rows), 1024):
        out[s : s + 1024] = rows[s : s + 1024].astype(float) @ taken.reshape(256, 512)
    return out.reshape(-1, 2)


def _count(model):
    """Words of each kind of text (in training texts, and in all), and first bytes by context, of either half of the texts.

    Rows of two sorts: a distinct word of a stretch of texts with its counts; a stretch of the counts of first bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = model.value
        k = len(kinds.prior)
        names = _names(k)
        _OPEN.clear()  # what this worker has held for other stages
        _FROZEN.clear()
        give_back()
        counts = np.zeros((2, CELLS), np.int32)
        held: list[tuple[pa.Array, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            coded = pa.concat_arrays([w for w, _ in held]).dictionary_encode()
            n, at = len(coded.dictionary), coded.indices.to_numpy()
            rows = np.concatenate([t for _, t in held])
            sums = [pa.array(np.bincount(at, rows[:, i], n).astype(np.int64)) for i in range(2 * k)]
            held.clear()
            return pa.RecordBatch.from_arrays([coded.dictionary, *sums, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)

        for b in pieces(batches, rows=1000, size=PIECE):
            learn = b.column("learn").to_numpy(zero_copy_only=False)
            q = Spoken(b.column("text"), kinds)
            fits = b.column("fits").to_numpy(zero_copy_only=False)
            for k2, some in enumerate((learn & ~fits, learn & fits)):
                if some.any():
                    _opening_cells(q, counts[k2], some[q.text])
            group = q.kind * 2 + ~learn
            n = len(q.distinct) + 1
            held.append((pa.concat_arrays([q.distinct, pa.array([END], pa.binary())]), np.bincount(q.codes * (2 * k) + group[q.text], minlength=n * 2 * k).astype(np.int32).reshape(n, 2 * k)))
            if sum(len(w) for w, _ in held) > 300_000:
                yield flush()
        if held:
            yield flush()
        if counts.any():
            flat = counts.reshape(-1)
            found = [i for i in range(0, 2 * CELLS, _SEGMENT) if flat[i : i + _SEGMENT].any()]
            m = len(found)
            parts = [zlib.compress(flat[i : i + _SEGMENT].astype("<u4").tobytes(), 1) for i in found]
            zero = [pa.array(np.zeros(m, np.int64))] * (2 * k)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.binary()), *zero, pa.array([i // _SEGMENT for i in found], pa.int32()), pa.array(parts, pa.binary())], names=names)

    return run


def _names(k: int) -> list[str]:
    return ["word", *(f"{x}{i}" for i in range(k) for x in "ch"), "part", "cells"]


def _fit_openings(model):
    """A mixer for each shard of texts, which it learns online in the order of the texts' hashes; what it mixes are counts of the other half of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, code, logits, seen = _opened(model.value)
        mixer, shard, held, size = None, None, [], 0

        def learn() -> None:
            q = Spoken(pa.array(held, pa.binary()), kinds, code)
            for on, x, gate, one in openings(q, logits, seen):
                for s in range(0, len(one), 8192):
                    u = slice(s, s + 8192)
                    mixer.learn(x[:, u], gate[u], one[u], 0.02 / (1 + mixer.seen / 5e6))

        def done() -> pa.RecordBatch:
            if held:
                learn()
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "mixer": [mixer.packed()], "seen": [mixer.seen]})

        for b in batches:
            for s, one_text in zip(b.column("shard").to_pylist(), b.column("text").to_pylist(), strict=True):
                if s != shard:
                    if shard is not None:
                        yield done()
                    mixer, shard, held, size = Mixer.fresh(OPEN_GATES, OPENERS), s, [], 0
                held.append(one_text)
                size += len(one_text)
                if size >= PIECE:
                    learn()
                    held, size = [], 0
        if shard is not None:
            yield done()

    return run


def _sum_cells(key, parts):
    """Add up one stretch of the cells, of which each task sent at most one part."""
    total = np.zeros(_SEGMENT, np.float64)
    for part in parts.column("cells"):
        got = np.frombuffer(zlib.decompress(part.as_py()), "<u4")
        total[: len(got)] += got
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([zlib.compress(total.astype(np.float32).tobytes(), 1)], pa.binary())})


def _spell(words: pa.Array) -> pa.Array:
    """The words as they are spelled: the end of a text is the empty word."""
    return pc.if_else(pc.equal(words, pa.scalar(END, words.type)), pa.scalar(b"", words.type), words)


def _times(b: pa.RecordBatch, kinds: int, held_out: bool = False) -> np.ndarray:
    return np.stack([b.column(f"c{k}").to_numpy() + (b.column(f"h{k}").to_numpy() if held_out else 0) for k in range(kinds)], axis=1)


def _count_bits(code: Code, bits: int, kinds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, any_ = Tables(code, bits), False
        for b in batches:
            tables.add(_spell(b.column("word")), _times(b, kinds), b.column("deep").to_numpy(), deep=False)
            any_ |= bool(b.num_rows)
        if any_:
            for k, row in enumerate(tables.shared.reshape(-1, _SEGMENT)):
                if row.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([zlib.compress(row.tobytes(), 1)], pa.binary())], names=["segment", "part"])
        del tables
        give_back()

    return run


def _sum_parts(key, parts):
    """Add up one segment of a table, of which each counting task sent at most one part."""
    total = np.zeros(_SEGMENT, np.float64)
    for part in parts.column("part"):
        total += np.frombuffer(zlib.decompress(part.as_py()), np.float32)
    return pa.table({"segment": pa.array([key[0].as_py()]), "part": pa.array([zlib.compress(total.astype(np.float32).tobytes(), 1)], pa.binary())})


def own_tables(code: Code, shared: np.ndarray, bits: int, words: pa.Array | list[bytes], times: np.ndarray, deep_at: np.ndarray) -> Tables:
    """Tables for a set of words that holds all words of each of their beginnings."""
    words = _array(words)
    deep_bytes = np.maximum(np.diff(_offsets(words)) + 1 - deep_at, 0)[times.any(axis=1)]
    tables = Tables(code, bits, shared, deep_bytes=int(deep_bytes.sum()))
    if tables.own is not None:
        tables.add(words, times, deep_at, deep=True)
    return tables


def _held(batches: Iterator[pa.RecordBatch], kinds: int):
    got = [b for b in batches if b.num_rows]
    if not got:
        return None
    words = pa.concat_arrays([b.column("word") for b in got])
    order = pc.array_sort_indices(words).to_numpy().astype(np.int64)  # however they came
    join = lambda f: np.concatenate([f(b) for b in got])[order]
    return words.take(pa.array(order)), join(lambda b: _times(b, kinds)), join(lambda b: _times(b, kinds, True)), join(lambda b: b.column("deep").to_numpy())


def _fit(model, kinds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        code, shared, bits = _opened(model.value)
        if held := _held(batches, kinds):
            words, times, _, deep_at = held
            words = _spell(words)
            m = fit_words(own_tables(code, shared, bits, words, times, deep_at), words, times, deep_at)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "mixer": [m.packed()], "seen": [m.seen]})

    return run


def _score_words(model, mixer: Mixer, kinds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        code, shared, bits = _opened(model.value)
        if not (held := _held(batches, kinds)):
            return
        names, times, every, deep_at = held
        words = _spell(names)
        tables = own_tables(code, shared, bits, words, times, deep_at)
        lp = np.zeros((len(words), kinds))
        for k in range(kinds):
            some = np.flatnonzero(every[:, k])
            lp[some, k] = log_probabilities(mixer, tables, words.take(pa.array(some)), k, deep_at[some])
        cols = [pa.array(word_hashes(names).view(np.int64)), pa.array(times.sum(axis=1)), pa.array(every.sum(axis=1)), *(pa.array(lp[:, k]) for k in range(kinds))]
        yield from pa.Table.from_arrays(cols, names=["h", "c", "c_all", *(f"lp{k}" for k in range(kinds))]).to_batches(10_000)

    return run


OWN = {"copies": "long", "n_tokens": "long", "n_bytes": "long", "n_known": "long", "base_score": "double", "score": "double"}
ROWS = f"doc_id long, th long, learn boolean, kind int, h long, n long, own struct<{', '.join(f'{k}: {v}' for k, v in OWN.items())}>"


def _look_up(model, total: int, distinct: int):
    """Per text one row with its sums over common words and first bytes, and one row for each other distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _FROZEN.clear()  # what this worker has held for other stages
        give_back()
        kinds, code, mixer, logits, seen, head, c, lp = _opened(model.value)
        base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1))) if total else np.zeros(len(c))
        for b in pieces(batches, rows=1000, size=PIECE):
            q = Spoken(b.column("text"), kinds, code, sort=True)
            likely = np.ones(len(q.codes))
            for on, x, gate, one in openings(q, logits, seen):
                p = mixer.probability(x, gate)
                likely[on] *= np.where(one, p, 1 - p)  # a code has some dozen decisions, of 1e-7 at least each
            gain = np.empty(len(q.codes))
            gain[q.order] = np.log10(likely)
            signed = q.hash.view(np.int64)
            by_hash = np.argsort(signed)  # neighbours are found together
            at = np.empty(len(signed), np.int64)
            at[by_hash] = np.searchsorted(head, signed[by_hash])
            at[at == len(head)] = 0
            common = head[at] == signed if len(head) else np.zeros(len(signed), bool)
            known = common[q.codes]
            t, where = q.text[known], at[q.codes[known]]
            gain[known] += lp[where, q.kind[t]]
            add = lambda v, w=None: np.bincount(v, w, q.n)
            tokens = np.diff(q.at)
            sizes = np.append(np.diff(np.frombuffer(q.distinct.buffers()[1], np.int32)[: len(q.distinct) + 1]), 0) if len(q.distinct) else np.zeros(1, np.int64)
            n_bytes = add(q.text, sizes[q.codes]).astype(np.int64) + np.maximum(0, tokens - 2)
            # other words, once for each text
            key, times = np.unique(q.text[~known] * len(q.hash) + q.codes[~known], return_counts=True)
            rest, own = key // len(q.hash), q.n
            rows = pa.array(np.concatenate([np.arange(own), rest]))
            values = [
                np.ones(own, np.int64), tokens, n_bytes, add(t, (c[where] > 0).astype(float)).astype(np.int64),
                add(t, base[where]), add(q.text, gain) + np.log10(kinds.prior)[q.kind],
            ]
            sums = pa.StructArray.from_arrays([pa.array(v) for v in values], names=list(OWN))
            # a text's own row must meet no word and no crowd: its key is its own hash
            h = np.concatenate([b.column("th").to_numpy(), signed[key % len(q.hash)]])
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(x).take(rows) for x in ("doc_id", "th", "learn")), pa.array(np.concatenate([q.kind, q.kind[rest]]), pa.int32()),
                    pa.array(h), pa.array(np.concatenate([np.zeros(own, np.int64), times])), pa.concat_arrays([sums, pa.nulls(len(rest), sums.type)]),
                ],
                names=["doc_id", "th", "learn", "kind", "h", "n", "own"],
            )

    return run


def with_beginnings(words: DataFrame, limit: int, ws: Workspace) -> DataFrame:
    """Adds ``deep``: the least length in ``STEPS_DEEP`` whose beginning at most ``limit`` words share with this one, or ``NEVER``.

    A crowd such as all addresses of one site is so split by ever longer beginnings.
    """
    out = words.withColumn("deep", F.lit(STEPS_DEEP[0]))
    for short, longer in zip(STEPS_DEEP, [*STEPS_DEEP[1:], NEVER], strict=True):
        crowds = out.where(F.col("deep") == short).groupBy(F.substring("word", 1, short).alias("start")).count().where(F.col("count") > limit).select("start")
        crowds = ws.save(crowds, f"crowds{short}")
        if crowds.isEmpty():
            break
        crowded = F.col("deep").eqNullSafe(short) & F.col("start").isNotNull()
        out = out.join(crowds, F.substring("word", 1, short) == F.col("start"), "left").withColumn("deep", F.when(crowded, F.lit(longer)).otherwise(F.col("deep"))).drop("start")
    return out


@dataclass
class Model:
    """What scoring sends to all tasks; values of words are a table."""

    kinds: Kinds
    firsts: Code
    code: Code
    opening: Mixer
    counts: np.ndarray
    mixer: Mixer
    shared: np.ndarray
    bits: int
    scored: DataFrame
    counted: DataFrame
    tokens: int
    distinct: int


def fit_model(rows: DataFrame, bits: int = TABLE_BITS, kinds: int = KINDS, ws: Workspace | None = None) -> Model:
    """Learn from the rows (text binary, learn boolean) with ``learn``; words of all rows get values."""
    spark = rows.sparkSession
    ws = ws or Workspace(spark, "context-mixing")
    shape = ws.save(rows.where("learn").select("text").mapInArrow(_histograms, "vector binary, bytes binary"), "shape")
    total = np.zeros((2, 256), np.int64)
    for r in shape.where("bytes is not null").select("bytes").mapInArrow(_byte_counts, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        total.reshape(-1)[r["at"]] = r.n
    firsts, code = map(byte_code, total)
    known = learn_kinds(shape.where("vector is not null").select("vector"), kinds)

    names = _names(kinds)
    longs = [x for x in names if x[0] in "ch" and x[1:].isdigit()]
    schema = ", ".join(["word binary", *(f"{x} long" for x in longs), "part int, cells binary"])
    told = F.xxhash64("text")
    fits = (F.pmod(told, F.lit(HALVES)) == HALVES - 1).alias("fits")
    first = ws.save(rows.select("text", "learn", fits).mapInArrow(_count(spark.sparkContext.broadcast(known)), schema), "first")
    counted = ws.save(with_beginnings(ws.save(first.where("word is not null").groupBy("word").agg(*(F.sum(x).alias(x) for x in longs)), "words"), LOCAL_WORDS // 2, ws), "counted")
    pairs = np.zeros((2, CELLS), np.float32)
    for r in first.where("cells is not null").select("part", "cells").groupBy("part").applyInArrow(_sum_cells, "part int, cells binary").collect():
        got = np.frombuffer(zlib.decompress(r.cells), np.float32)
        to = pairs.reshape(-1)[r.part * _SEGMENT : (r.part + 1) * _SEGMENT]
        to[:] = got[: len(to)]
    # the mixer of first bytes: each half of the texts meets the counts of the other one, dealt to shards by hashes
    sizes = {r.fits: r.size for r in rows.where("learn").groupBy(fits).agg(F.sum(F.octet_length("text")).alias("size")).collect()}
    halves = []
    for half in range(HALVES):
        some = rows.where("learn").where(fits if half else ~fits).select("text", told.alias("h"))
        shards = max(1, min(4096, sizes.get(bool(half), 0) // SHARD_BYTES))
        some = some.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int")).repartition(shards, "shard").sortWithinPartitions("shard", "h")
        model = spark.sparkContext.broadcast(_packed(known, firsts, *opening_inputs(opening_counts(pairs[1 - half], firsts))))
        halves.append(_averaged(some.select("shard", "text").mapInArrow(_fit_openings(model), MIXERS), OPEN_GATES, OPENERS))
        model.destroy()
    opening = Mixer.average([(m.packed(), m.seen) for m in halves if m.seen], OPEN_GATES, OPENERS)
    counts = opening_counts(pairs.sum(axis=0), firsts)

    every = sum((F.col(f"c{k}") for k in range(1, kinds)), F.col("c0"))
    n, v, v_all = counted.agg(F.coalesce(F.sum(every), F.lit(0)), F.count_if(every > 0), F.count("*")).first()
    dealt = counted.where(every > 0).repartition(max(1, -(-v // TRAIN_WORDS)), F.xxhash64("word"))
    parts = dealt.mapInArrow(_count_bits(code, bits, kinds), "segment long, part binary").groupBy("segment").applyInArrow(_sum_parts, "segment long, part binary")
    shared = Tables(code, bits).shared
    flat = shared.reshape(-1, _SEGMENT)
    for r in parts.collect():
        flat[r.segment] = np.frombuffer(zlib.decompress(r.part), np.float32)
    # words of one beginning in one task; those without a crowd's end by themselves
    beginning = F.xxhash64(F.when(F.col("deep") < NEVER, F.substring(F.col("word"), F.lit(1), F.col("deep"))).otherwise(F.col("word")))
    tasks = max(1, -(-v_all // LOCAL_WORDS))
    model = spark.sparkContext.broadcast(_packed(code, shared, bits))
    fitted = counted.where(every > 0).repartition(max(1, -(-v // LOCAL_WORDS)), beginning).mapInArrow(_fit(model, kinds), MIXERS)
    mixer = _averaged(fitted, WORD_GATES, PREDICTORS)
    lps = ", ".join(f"lp{k} double" for k in range(kinds))
    scored = ws.save(counted.repartition(tasks, beginning).mapInArrow(_score_words(model, mixer, kinds), f"h long, c long, c_all long, {lps}"), "scored")
    model.destroy()
    return Model(known, firsts, code, opening, counts, mixer, shared, bits, scored, counted, n, v)


MIXERS = "shard int, mixer binary, seen double"


def _averaged(mixers: DataFrame, gates: int, predictors: int) -> Mixer:
    """The mean of the mixers of all shards, worked out in their order: groups of shards on the executors first."""

    def mean(rows: pa.Table) -> pa.Table:
        got = sorted((s, m, n) for s, m, n in zip(*(rows.column(c).to_pylist() for c in ("shard", "mixer", "seen")), strict=True) if n)
        m = Mixer.average([(m, n) for _, m, n in got], gates, predictors)
        return pa.table({"shard": pa.array([rows["shard"][0].as_py() // GROUP_SHARDS], pa.int32()), "mixer": pa.array([m.packed()], pa.binary()), "seen": pa.array([float(m.seen)])})

    rows = mixers.groupBy(F.floor(F.col("shard") / GROUP_SHARDS)).applyInArrow(mean, MIXERS).collect()
    return Mixer.average([(r.mixer, r.seen) for r in sorted(rows) if r.seen], gates, predictors)


def score_documents(docs: DataFrame, bits: int = TABLE_BITS, kinds: int = KINDS, head_words: int = HEAD_WORDS, ws: Workspace | None = None) -> DataFrame:
    """Score every whole text by a unigram base and by the context-mixing model.

    ``docs``: doc_id long, text string; further columns are ignored. Per input row: doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score, score, bits_per_byte. A-Z are lower-cased; tokens are
    runs of bytes other than ASCII white space, and one end. Rows whose crc32 of the id, mod 5, is
    not 1 are learned from: kinds, byte code, all words by kind, every decision of every word and first byte, in
    counts that grow with the corpus. Shared tables have 2 ** ``bits`` slots each; contexts of long beginnings belong to the
    task that holds all words of a beginning. Mixers are learned online in tasks and averaged. What follows a
    word's first byte is worked out once for each distinct word; values of the ``head_words``
    most common ones go to all tasks, the others are joined by a 64-bit hash. A text's score is that under its likeliest
    kind, with the kind's own probability: a lower bound of the mixture over kinds.

    Null texts are empty: the end alone. Repeated rows get equal results. Without training rows, base
    scores are 0 and the model is flat. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.coalesce(fold() != 1, F.lit(True)).alias("learn"))
    return score_rows(rows, fit_model(rows, bits, kinds, ws or Workspace(spark, "context-mixing")), head_words)


def score_rows(rows: DataFrame, m: Model, head_words: int = HEAD_WORDS) -> DataFrame:
    """Scores of the rows (doc_id, text binary, learn) that the model was fitted for."""
    spark, kinds, n, v = rows.sparkSession, len(m.kinds.prior), m.tokens, m.distinct
    lps = [f"lp{k}" for k in range(kinds)]
    # the words from some number of occurrences on, at most ``head_words``: found from counts by size, without a sort in one task
    size = F.floor(F.log2("c_all") * 16)
    least, held = 1 << 30, 0
    for r in sorted(m.scored.groupBy(size.alias("size")).count().collect(), reverse=True):
        if held + r["count"] > head_words:
            break
        least, held = r["size"], held + r["count"]
    top = m.scored.where(size >= least).select("h", "c", *lps).toArrow()
    head = top.column("h").to_numpy()
    order = np.argsort(head)
    values = np.stack([top.column(x).to_numpy() for x in lps], axis=1)[order].astype(np.float32)
    model = spark.sparkContext.broadcast(_packed(m.kinds, m.firsts, m.opening, *opening_inputs(m.counts), head[order], top.column("c").to_numpy()[order], values))
    looked = rows.withColumn("th", F.xxhash64("doc_id", "text")).select("doc_id", "text", "th", "learn").mapInArrow(_look_up(model, n, v), ROWS)
    unigram = F.log10((F.coalesce("w_c", F.lit(0)) + 0.5) / F.lit(n + 0.5 * (v + 1))) if n else F.lit(0.0)
    own = F.col("own").isNotNull()
    words = m.scored.select(F.col("h"), F.col("c").alias("w_c"), F.array(*lps).alias("w_lp"))
    counts, sums = ["copies", "n_tokens", "n_bytes", "n_known"], ["base_score", "score"]
    summed = (
        looked.join(words.hint("shuffle_hash"), "h", "left")  # some tens of thousands of words a partition: sorts would cost more
        .select(
            "doc_id", "th", "learn", "own.copies", "own.n_tokens", "own.n_bytes",
            F.when(own, F.col("own.n_known")).otherwise(F.when(F.col("w_c") > 0, F.col("n")).otherwise(0)).alias("n_known"),
            F.when(own, F.col("own.base_score")).otherwise(F.col("n") * unigram).alias("base_score"),
            F.when(own, F.col("own.score")).otherwise(F.col("n") * F.get("w_lp", F.col("kind"))).alias("score"),
        )
        .groupBy("doc_id", "th", "learn")
        .agg(*(F.sum(c).alias(c) for c in [*counts, *sums]))
    )
    whole = lambda c: (F.col(c) / F.col("copies")).cast("long").alias(c)
    return (
        summed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(
            "doc_id", (~F.col("learn")).alias("held_out"), whole("n_tokens"), whole("n_known"), F.lit(n).cast("long").alias("train_tokens"),
            (F.col("base_score") / F.col("copies")).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"),
            (-F.try_divide(F.col("score"), F.col("n_bytes")) * F.lit(float(np.log2(10)))).alias("bits_per_byte"),
        )
    )
