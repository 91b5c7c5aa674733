"""An FM-index over the words of a block of texts: a wavelet matrix with ranks, and sampled suffix positions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Every so many positions of the texts have their place kept; others are reached by so many steps back at most.
SAMPLE = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The order of all suffixes, by doubling; each text ends in a symbol of its own, so no comparison passes an end."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    bits = max(1, int(symbols.max()).bit_length())
    depth = max(1, min(4, 62 // bits, n))
    key = symbols.astype(np.int64) << (bits * (depth - 1))
    for k in range(1, depth):
        key[: n - k] |= symbols[k:].astype(np.int64) << (bits * (depth - 1 - k))
    order = np.argsort(key)
    key = key[order]
    first = np.ones(n, bool)
    first[1:] = key[1:] != key[:-1]
    heads = np.flatnonzero(first)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    slots = np.flatnonzero(~(first & np.append(first[1:], True)))  # places of suffixes that still share theirs
    while len(slots):
        at = order[slots]
        key = rank[at] * n + rank[at + depth]
        by = np.argsort(key)
        key, at = key[by], at[by]
        first = np.ones(len(slots), bool)
        first[1:] = key[1:] != key[:-1]
        heads = np.flatnonzero(first)
        order[slots] = at
        rank[at] = np.repeat(slots[heads], np.diff(np.append(heads, len(slots))))
        slots = slots[~(first & np.append(first[1:], True))]
        depth *= 2
    return order


def _packed(bits: np.ndarray) -> np.ndarray:
    room = np.zeros((len(bits) // 64 + 1) * 64, bool)
    room[: len(bits)] = bits
    return np.packbits(room, bitorder="little").view(np.uint64)


def _before(packed: np.ndarray) -> np.ndarray:
    """Ones before each 64-bit word."""
    ones = np.cumsum(np.bitwise_count(packed), dtype=np.int64)
    return np.concatenate([[0], ones[:-1]]).astype(np.int32)


@dataclass
class FMIndex:
    """Rows are suffixes in order; symbol 0 ends a text, word w is symbol w + 1."""

    size: int
    bits: np.ndarray  # level x 64-bit words
    ones: np.ndarray  # level x ones before a 64-bit word
    zeros: np.ndarray  # of each level
    base: np.ndarray  # of a symbol: its first row less its first place in the last level
    marks: np.ndarray  # rows whose position is kept
    marks_before: np.ndarray
    places: np.ndarray  # their positions

    @classmethod
    def build(cls, words: np.ndarray, lengths: np.ndarray, vocabulary: int) -> FMIndex:
        """Over texts of so many ``words`` each; a word is a number below ``vocabulary``."""
        texts = len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        n = int(ends[-1]) + 1 if texts else 0
        symbols = np.empty(n, np.int32)
        is_end = np.zeros(n, bool)
        is_end[ends] = True
        symbols[ends] = np.arange(texts)
        symbols[~is_end] = words + texts
        order = suffix_order(symbols)
        symbols[~is_end] -= texts - 1
        symbols[ends] = 0
        counts = np.bincount(symbols, minlength=vocabulary + 1)
        before = symbols[order - 1]  # the symbol before each suffix, in order
        kept = (order % SAMPLE == 0) | (before == 0)
        levels = max(1, int(vocabulary).bit_length())
        bits, ones, zeros = [], [], []
        now = before
        for level in range(levels - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            packed = _packed(bit)
            bits.append(packed)
            ones.append(_before(packed))
            rest = now[~bit]
            zeros.append(len(rest))
            now = np.concatenate([rest, now[bit]])
        base = np.cumsum(counts) - counts
        heads = np.flatnonzero(np.append(True, now[1:] != now[:-1])) if n else np.zeros(0, np.int64)
        base[now[heads]] -= heads
        marks = _packed(kept)
        return cls(n, np.stack(bits), np.stack(ones), np.array(zeros, np.int32), base.astype(np.int32), marks, _before(marks), order[kept].astype(np.int32))

    def arrays(self) -> dict[str, bytes]:
        return {k: np.ascontiguousarray(getattr(self, k)).tobytes() for k in ARRAYS}

    @classmethod
    def of(cls, size: int, arrays: dict[str, bytes]) -> FMIndex:
        a = {k: np.frombuffer(arrays[k], t) for k, t in ARRAYS.items()}
        levels = len(a["zeros"])
        return cls(size, **(a | {"bits": a["bits"].reshape(levels, -1), "ones": a["ones"].reshape(levels, -1)}))

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a level before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[level][word] + np.bitwise_count(self.bits[level][word] & below)

    def step(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The first row of symbol, then what comes before ``rows`` by it: one step of the backward search."""
        at = rows.astype(np.int64)
        levels = len(self.zeros)
        for k in range(levels):
            ones = self._rank(k, at)
            at = np.where((symbols >> (levels - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at + self.base[symbols]

    def back(self, rows: np.ndarray) -> np.ndarray:
        """The row of the suffix that is one symbol longer."""
        at, symbol = rows.astype(np.int64), np.zeros(len(rows), np.int64)
        levels = len(self.zeros)
        for k in range(levels):
            bit = (self.bits[k][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            ones = self._rank(k, at)
            symbol = symbol * 2 + bit.astype(np.int64)
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return at + self.base[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) that begin with each phrase; phrases are rows of words, aligned to the right, -1 for a word that occurs nowhere."""
        n, width = phrases.shape
        low, high = np.zeros(n, np.int64), np.full(n, self.size)
        known = np.where(np.arange(width)[None] >= width - lengths[:, None], phrases >= 0, True).all(axis=1) & (lengths > 0)
        high[~known] = 0
        for k in range(width):
            on = np.flatnonzero((low < high) & (k < lengths))
            if not len(on):
                break
            symbols = phrases[on, width - 1 - k].astype(np.int64) + 1
            both = self.step(np.concatenate([symbols, symbols]), np.concatenate([low[on], high[on]]))
            low[on], high[on] = both[: len(on)], both[len(on) :]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of suffixes in the texts laid end to end, each followed by its end."""
        out, walk, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.astype(np.int64), 0
        while len(walk):
            kept = ((self.marks[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            hit = at[kept]
            below = (np.uint64(1) << (hit & 63).astype(np.uint64)) - np.uint64(1)
            out[walk[kept]] = self.places[self.marks_before[hit >> 6] + np.bitwise_count(self.marks[hit >> 6] & below)] + steps
            walk, at = walk[~kept], self.back(at[~kept])
            steps += 1
        return out


#: The arrays of an index, as stored.
ARRAYS = {
    "bits": np.uint64, "ones": np.int32, "zeros": np.int32, "base": np.int32,
    "marks": np.uint64, "marks_before": np.int32, "places": np.int32,
}
