"""Column expressions on paths, text and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the trimming of source lines knows it (fixed values).
SPACES = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
MARK = ("…<truncated ", " bytes>")


def trimmed(c: Column) -> Column:
    """Without white space at both ends, byte order marks and no-break spaces included."""
    return F.regexp_replace(c, f"^[{SPACES}]+|[{SPACES}]+$", "")


def session_id(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "\\.jsonl$", "")


def decode_project_dir(path: Column) -> Column:
    """The project path that the file's folder encodes; dashes are ambiguous, so it is a fallback."""
    parts = F.split(path, "/")
    name = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(""))
    return F.replace(name, F.lit("-"), F.lit("/"))


def non_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def shed_string(c: Column, most: int) -> Column:
    """A string over ``most`` bytes as its first ``most`` characters and a mark of the bytes lost.

    Exact where every character is one UTF-16 unit; ``helpers.shed`` cuts the others. The test is on
    bytes and the cut on characters: a string of few but wide characters may lose nothing and
    still gets the mark.
    """
    head = F.substring(c, 1, most)
    lost = (F.octet_length(c) - F.octet_length(head)).cast("string")
    return F.when(F.octet_length(c) > most, F.concat(head, F.lit(MARK[0]), lost, F.lit(MARK[1]))).otherwise(c)


#: Stands behind a value that is checked; text that holds it is checked another way.
_AFTER = "~after~the~value~"


def wrapped(c: Column) -> Column:
    """The text in an array, ahead of a mark, parsed; null where that is no JSON. One parse serves check and fields."""
    return F.try_parse_json(F.concat(F.lit("["), c, F.lit(f',"{_AFTER}"]')))


def is_json(c: Column, parsed: Column) -> Column:
    """True for exactly one JSON value, as a strict parser sees it; very deep or long values may be missed.

    The parser itself accepts text after a value. A value that is followed by the mark, and the
    mark by nothing, stands alone.
    """
    alone = (F.try_variant_get(parsed, "$[1]", "string") == _AFTER) & F.try_variant_get(parsed, "$[2]", "variant").isNull()
    return F.coalesce(alone & ~F.contains(c, F.lit(_AFTER)), F.lit(False))


def string_field(parsed: Column, name: str) -> Column:
    """A field of a wrapped object if it is a non-empty string, else null: 5 is no path."""
    kind = F.schema_of_variant(F.try_variant_get(parsed, f"$[0].{name}", "variant"))
    return F.when(kind == "STRING", non_empty(F.try_variant_get(parsed, f"$[0].{name}", "string")))


#: Where text may differ from what serialising its value gives: escapes by number, numbers with a fraction, an exponent,
#: many digits or a sign before zero, and keys that are numbers.
_UNLIKE = r'\\u|(^|[:\[,])(-0|-?[0-9]+[.eE]|-?[0-9]{16})|"[0-9]+":'


def is_compact(c: Column, parsed: Column) -> Column:
    """True where the text is for sure what serialising its value gives: no white space, repeated keys or odd escapes.

    All these make the text longer than the value's compact form, but for what ``_UNLIKE`` finds.
    """
    size = F.octet_length(F.to_json(F.try_variant_get(parsed, "$[0]", "variant")))
    return F.coalesce((F.octet_length(c) == size) & ~F.rlike(c, F.lit(_UNLIKE)), F.lit(False))
