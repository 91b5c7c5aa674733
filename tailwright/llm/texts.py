"""Words of many texts at once, in Arrow arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import mix64

PRIME = np.uint64(0x9E3779B97F4A7C15)
_POWERS = {0: np.ones(1, np.uint64)}


def powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        p = np.full(max(n, 64), PRIME, np.uint64)
        p[0] = 1
        _POWERS[0] = np.multiply.accumulate(p)
    return _POWERS[0]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = np.arange(1, 257, dtype=np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: What parts words of letters and digits: ASCII but for those.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
#: What ends a piece of a sentence, and what parts words beside that.
PIECE_ENDS = np.zeros(256, bool)
PIECE_ENDS[[*b".,;:!?", 10, 11, 12, 13]] = True
PIECE_GAPS = PIECE_ENDS.copy()
PIECE_GAPS[[9, 32]] = True


def words_of(texts: pa.Array, gaps: np.ndarray = _BLANK) -> tuple[pa.Array, np.ndarray]:
    """The words of binary texts in a row, A-Z in lower case, and where each text's begin, with the end."""
    words, starts, _, _ = placed_words(texts, gaps)
    return words, starts


def placed_words(texts: pa.Array, gaps: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """As ``words_of``, and the byte that each word begins at, and the bytes of all texts."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    text = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    raw = text.tobytes()  # whose translation is much quicker than looking up bytes one by one
    full = np.frombuffer(raw.translate((~gaps).tobytes()), bool)
    begins, ends = full.copy(), full.copy()
    begins[1:] &= ~full[:-1]
    ends[:-1] &= ~full[1:]
    inner = at[:-1][at[:-1] < len(text)]
    begins[inner] = full[inner]
    last = at[1:][at[1:] > 0] - 1
    ends[last] = full[last]
    places = np.flatnonzero(begins)
    offsets = np.append(0, np.cumsum(np.flatnonzero(ends) + 1 - places)).astype(np.int32)
    data = raw.translate(_LOWER.tobytes(), np.flatnonzero(gaps).astype(np.uint8).tobytes())
    words = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return words, np.searchsorted(places, at), places, text


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; none is empty."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1].astype(np.int64)
    if not len(words):
        return np.zeros(0, np.uint64)
    data, sizes = np.frombuffer(words.buffers()[2], np.uint8)[: offsets[-1]], np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
    return mix64(np.add.reduceat(mix64(_BYTES)[data] * powers(int(sizes.max()) + 1)[place], offsets[:-1]) + sizes.astype(np.uint64))


def word_hash(word: bytes) -> int:
    return int(word_hashes(pa.array([word], pa.binary())).view(np.int64)[0])
