"""Line-first quality rules: clean lines, then reject documents that lose too much text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches

SYMBOLS = b"#*$%&|<>"
#: Phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "licensed under",
    "lorem ipsum",
    "privacy policy",
    "released under the",
    "sign up for our newsletter",
    "terms of service",
    "terms of use",
    "this work is licensed",
    # the same in German, French and Spanish, as far as they are plain ASCII
    "alle rechte vorbehalten",
    "cookies akzeptieren",
    "nutzungsbedingungen",
    "accepter les cookies",
    "politique de confidentialit",
    "aceptar las cookies",
    "aviso legal",
    "todos los derechos reservados",
)


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; percentages are of the line's words, the last one of the document's."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: punctuation: more symbol characters than this, a share of words ending in doubled marks, or a
    #: shorter line than ``bare_words`` that has no punctuation at its end.
    max_symbol_percent: int = 30
    max_shout_percent: int = 30
    bare_words: int = 4
    #: navigation: at least so many words that are separators alone
    max_separator_percent: int = 20
    #: words of removed lines
    max_lost_percent: int = 30


_DOUBLED = re.compile(rb"(?:!!|\?\?|\*\*|\$\$|%%|##|&&)$")
_SEPARATOR = {b"|", b">", b"<", b"/", b"-", b"*", b"\xc2\xb7", b"\xe2\x80\xa2", b"\xc2\xbb", b"\xe2\x80\xba"}
_ENDS = tuple(x.encode() for x in ".!?:;\"')]}…”’»。！？")
_PHRASES = re.compile(b"|".join(re.escape(p.encode()) for p in BOILERPLATE))
_DROP = bytes(range(256)).translate(None, SYMBOLS)


def n_symbols(text: bytes) -> int:
    return len(text.translate(None, _DROP))


def line_fails(line: bytes, words: list[bytes], earlier: bool, rules: Rules) -> str | None:
    """The first rule that a line with words fails: punctuation, navigation or boilerplate."""
    n = len(words)
    separators = sum(w in _SEPARATOR for w in words)
    if n >= 2 and 100 * separators > rules.max_separator_percent * n:
        return "navigation"
    if 100 * n_symbols(line) > rules.max_symbol_percent * n:
        return "punctuation"
    if (b"!!" in line or b"??" in line) and 100 * sum(bool(_DOUBLED.search(w)) for w in words) > rules.max_shout_percent * n:
        return "punctuation"
    if n < rules.bare_words and not words[-1].endswith(_ENDS):
        return "punctuation"
    if earlier or _PHRASES.search(line.lower()):
        return "boilerplate"
    return None


def repeated_words(words: list[bytes], k: int = 3) -> int:
    """Words covered by k-word windows that occur twice or more in the text, first ones included."""
    n = len(words)
    if n <= k:
        return 0
    seen: dict[bytes, int] = {}
    h = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    base = len(seen)
    key = h[:-2] * base + h[1:-1] if base < 3_000_000_000 else None
    _, pair = np.unique(key, return_inverse=True)
    _, inverse, counts = np.unique(pair * base + h[2:], return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    cover = np.zeros(n, bool)
    for j in range(k):
        cover[j : n - k + 1 + j] |= twice
    return int(cover.sum())


def clean(text: bytes | None, rules: Rules) -> tuple:
    """Base counts, the kept lines and what each rule removed, for one whole text."""
    text = text or b""
    words = text.split()
    seen: set[bytes] = set()
    dup = lost = 0
    fails = {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    kept_lines = []
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            kept_lines.append(line)
            continue
        earlier = line in seen
        dup += earlier
        seen.add(line)
        why = line_fails(line, own, earlier, rules)
        if why:
            fails[why] += 1
            lost += len(own)
        else:
            kept_lines.append(line)
    n = len(words)
    # code points: all bytes that do not continue a character
    chars = sum(map(len, words)) - len(text.translate(None, _NOT_CONTINUING))
    repeat = repeated_words(words)
    failed = n < rules.min_words or 100 * repeat > rules.max_repeat_percent * n
    kept = not failed and 100 * lost <= rules.max_lost_percent * n
    return (n, chars, n_symbols(text), dup, repeat, failed, kept, lost, *fails.values(), b"\n".join(kept_lines))


_NOT_CONTINUING = bytes(b for b in range(256) if not 0x80 <= b < 0xC0)
_LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_REMOVED = ["lost_words", "punctuation_lines", "navigation_lines", "boilerplate_lines"]
_SCHEMA = f"{', '.join(f'{c} long' for c in _LONGS)}, base_failed boolean, kept boolean, {', '.join(f'{c} long' for c in _REMOVED)}"


def _apply(rules: Rules, cleaned: bool, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, column):
            if not batch.num_rows:
                continue
            cols = list(zip(*(clean(t, rules) for t in batch.column(column).cast(pa.binary()).to_pylist()), strict=True))
            own = [c for c in batch.schema.names if c.startswith("kept_")]
            arrays = [*(batch.column(c) for c in own), *(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.bool_()) for c in cols[5:7]), *(pa.array(c, pa.int64()) for c in cols[7:11])]
            names = [*own, *_LONGS, "base_failed", "kept", *_REMOVED]
            if cleaned:
                arrays.append(pa.array([c.decode("utf-8", "replace") for c in cols[11]], pa.string()))
                names.append("cleaned_text")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def quality_rules(docs: DataFrame, rules: Rules = Rules(), cleaned: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Counts, verdict and cleaned text of every document.

    ``docs``: doc_id long, text string; further columns are ignored but those of ``keep``, which come
    first (by default doc_id). One row per input row. Words
    are runs of bytes other than ASCII white space. Every line with words is held against the
    navigation, punctuation and boilerplate rules (a line equal to an earlier one is boilerplate);
    failing lines are left out of ``cleaned_text``. A document with few words or much repetition
    fails at the base; else it is kept unless the removed lines hold more than
    ``max_lost_percent`` of its words.

    Null and empty texts have zero counts, fail at the base and clean to ''. Repeated rows get equal
    results; an empty table gives no rows. Texts are never cut; a task holds one batch of them.
    """
    small_batches(docs.sparkSession)
    keep = keep or ["doc_id"]
    kinds = {k: t for k, t in docs.dtypes if k in keep} | {"doc_id": "long"}
    column = "kept_text" if kinds.get("text") == "string" else "text"  # a text that goes along goes once
    rows = docs.select(*(F.col(k).cast(kinds[k]).alias(f"kept_{k}") for k in keep), *([F.col("text").cast("binary").alias("text")] if column == "text" else []))
    schema = ", ".join([*(f"kept_{k} {kinds[k]}" for k in keep), _SCHEMA, *(["cleaned_text string"] if cleaned else [])])
    out = rows.mapInArrow(_apply(rules, cleaned, column), schema)
    names = [*_LONGS, "base_failed", "kept", *_REMOVED, *(["cleaned_text"] if cleaned else [])]
    return out.select(*(F.col(f"kept_{k}").alias(k) for k in keep), *names)
