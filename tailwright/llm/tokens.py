"""Encoding texts with a tokenizer file: texts are cut into words in numpy, and each word is encoded once."""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids a worker remembers (some 40 bytes each), and the longest of them in bytes.
REMEMBERED = 400_000
LONGEST = 64
#: Bytes of text that are cut at once.
SLICE = 4 << 20
_STRETCH = 1 << 18  # bytes classified at once: what fits a processor's cache

#: Kinds of bytes; those of characters that the rules here do not know for sure are never cut from their neighbours.
_UNSURE, _SPACE, _LETTER, _DIGIT, _SIGN, _QUOTE = range(6)


def _kinds() -> np.ndarray:
    k = np.full(256, _SIGN, np.uint8)
    k[28:32] = _UNSURE
    k[[9, 10, 11, 12, 13, 32]] = _SPACE
    k[48:58] = _DIGIT
    k[65:91] = k[97:123] = _LETTER
    k[39] = _QUOTE
    k[128:] = _UNSURE
    k[0xC3:0xCA] = _LETTER  # U+00C0 to U+024F, but for what _stretch takes back
    return k


def _cuts(drops_space: bool) -> np.ndarray:
    """Between which kinds both sorts of file split a text for sure, before they merge."""
    cut = np.zeros((8, 8), bool)
    cut[[_LETTER, _DIGIT, _SIGN, _QUOTE], _SPACE] = True
    for a, b in ((_LETTER, _DIGIT), (_LETTER, _SIGN), (_DIGIT, _SIGN)):
        cut[a, b] = cut[b, a] = True
    cut[[_LETTER, _DIGIT], _QUOTE] = True  # what follows a quote may be a contraction
    cut[_DIGIT, _DIGIT] = drops_space  # there, each digit stands alone
    return cut.ravel()


_KINDS = _kinds()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def _stretch(text: np.ndarray) -> np.ndarray:
    """The kind of each byte."""
    k = _KINDS[text]
    high = np.flatnonzero(text >= 0x80)
    if len(high):
        lead = text[high]
        two = high[(lead >= 0xC3) & (lead <= 0xC9) & (high + 1 < len(text))]
        first, second = text[two], text[two + 1]
        kind = np.full(len(two), _LETTER, np.uint8)
        kind[(first == 0xC3) & ((second == 0x97) | (second == 0xB7))] = _SIGN  # the signs of multiplication and division
        kind[(first == 0xC4) & (second == 0xB0)] = _UNSURE  # dotted I, two characters in lower case
        k[two] = k[two + 1] = kind
        three = high[(lead == 0xE2) & (high + 2 < len(text))]
        three = three[(text[three + 1] == 0x80) & (text[three + 2] >= 0x90) & (text[three + 2] <= 0xA7)]  # dashes, quotation marks, dots
        k[three] = k[three + 1] = k[three + 2] = _SIGN
    return k


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, drops_space: bool) -> Encoder:
    """The worker's encoder for a file: what one task has learned serves the next ones."""
    key = (path, drops_space)
    if key not in _ENCODERS:
        _ENCODERS.clear()  # one at a time holds memory
        _ENCODERS[key] = Encoder(path, drops_space)
    return _ENCODERS[key]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of many runs, one after another."""
    end = np.cumsum(lengths)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(starts - end + lengths, lengths)


class Encoder:
    """Ids of whole texts, equal to those of ``Tokenizer.encode(text, add_special_tokens=False)``.

    Both sorts of file split a text into words before they merge, so a word's ids depend on nothing
    around it. Texts are cut where such a split is certain, with the space ahead of a word left on it; the library encodes
    each distinct piece once, and a worker remembers the pieces that it met first, in Arrow
    and numpy arrays. ``drops_space``: the normalizer lower-cases, turns white space into one
    space, and the splitter drops it (word-end vocabularies). Texts that name a special token are encoded whole by the library,
    which gives them that token's id; with ``special_as_text`` such names are ordinary text.
    """

    def __init__(self, path: str, drops_space: bool, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.named = [] if special_as_text else sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()})
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if size < 1 << 16 else np.dtype("<u4")
        self.drops_space = drops_space
        self.cut = _cuts(drops_space)
        self.known = pa.array([], pa.binary())
        self.ids = np.zeros(0, self.dtype)
        self.lengths = np.zeros(0, np.int64)

    def _pieces(self, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where each piece of the texts that begin at ``starts`` begins."""
        cut = np.empty(len(text), bool)
        for s in range(0, len(text), _STRETCH):
            lo = max(0, s - 4)  # a character before tells the kind of what it ends with
            kind = _stretch(text[lo : s + _STRETCH + 4])[s - lo :][:_STRETCH]
            last = _stretch(text[lo:s])[-1] if s else np.uint8(_UNSURE)
            pair = kind.astype(np.uint8)
            pair[1:] |= kind[:-1] << 3
            pair[0] |= last << 3
            np.take(self.cut, pair, out=cut[s : s + _STRETCH])
        cut[starts] = True
        return np.flatnonzero(cut)

    def _encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat, lengths = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for s in range(0, len(pieces), 4096):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(pieces.slice(s, 4096).cast(pa.string()).to_pylist(), add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, got), np.int64, len(got)))
            flat.append(np.fromiter(chain.from_iterable(got), self.dtype, int(lengths[-1].sum())))
        return np.concatenate(flat), np.concatenate(lengths)

    def _look_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the pieces, and by code the ids' lengths and starts; new ones are encoded and remembered."""
        coded = pa.concat_arrays([self.known, pieces]).dictionary_encode()
        codes, n = coded.indices.to_numpy()[len(self.known) :], len(self.known)
        new = coded.dictionary.slice(n)
        ids, lengths = self._encode(new)
        all_lengths = np.concatenate([self.lengths, lengths])
        starts = np.cumsum(all_lengths) - all_lengths
        self.flat = np.concatenate([self.ids, ids])
        short = pc.less_equal(pc.binary_length(new), LONGEST)
        keep = np.flatnonzero(short.to_numpy(zero_copy_only=False))
        room = REMEMBERED - n
        if len(keep) > room:  # forget the later half: what a worker has met first is what it meets most
            half = min(n, REMEMBERED // 2)
            self.known, self.lengths = self.known.slice(0, half), self.lengths[:half]
            self.ids = self.flat[: int(self.lengths.sum())]
            keep = keep[: REMEMBERED - half]
        self.known = pa.concat_arrays([self.known, new.take(pa.array(keep))])
        self.ids = np.concatenate([self.ids, self.flat[ragged(starts[n + keep], lengths[keep])]])
        self.lengths = np.concatenate([self.lengths, lengths[keep]])
        return codes, all_lengths, starts

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin, with the end. Null texts are empty."""
        texts = texts.cast(pa.large_string())
        names = np.zeros(len(texts), bool)
        for name in self.named:
            head = name[: next((k for k, c in enumerate(name) if c.isalpha()), len(name))]  # quick to find, and rare
            some = np.flatnonzero(pc.match_substring(texts, head).fill_null(False).to_numpy(zero_copy_only=False))
            if len(some):  # in any case: a normalizer may change it
                names[some] |= pc.match_substring(texts.take(pa.array(some)), name, ignore_case=True).to_numpy(zero_copy_only=False)
        if not names.any():
            return self._encode_flat(texts)
        ids, at = self._encode_flat(pc.if_else(pa.array(names), "", texts))
        whole = iter([np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts.filter(pa.array(names)).to_pylist(), add_special_tokens=False)])
        parts = [next(whole) if names[k] else ids[at[k] : at[k + 1]] for k in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def _encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or at[-1] == at[0]:
            return np.zeros(0, self.dtype), np.zeros(len(texts) + 1, np.int64)
        text = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        if self.drops_space:
            text = _LOWER[text]
        begins = self._pieces(text, at[:-1][at[:-1] < len(text)])
        offsets = pa.py_buffer(np.append(begins, len(text)).astype(np.int32))
        codes, lengths, starts = self._look_up(pa.Array.from_buffers(pa.binary(), len(begins), [None, offsets, pa.py_buffer(text)]))
        n = lengths[codes]
        ids = self.flat[ragged(starts[codes], n)]
        before = np.concatenate([[0], np.cumsum(n)])
        return ids, before[np.searchsorted(begins, at)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, at = self.encode_flat(pa.array(texts, pa.large_string()))
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
