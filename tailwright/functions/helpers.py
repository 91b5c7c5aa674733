"""Small Python helpers for what column expressions cannot say: deep cuts, exact numbers, greedy packing."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import MARK

_SURROGATE = re.compile("[\ud800-\udfff]")


def _reject(name: str):
    raise ValueError(name)


def parse(text: str):
    """One strict JSON value with double-precision numbers; ValueError otherwise."""
    try:
        return json.loads(text, parse_int=float, parse_constant=_reject)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


def number(x: float) -> str:
    """Shortest digits, without exponent from 1e-6 up to under 1e21; infinities are null."""
    if x != x or x in (float("inf"), float("-inf")):
        return "null"
    if x == 0:
        return "0"
    sign, (digits, _, power) = "-" if x < 0 else "", repr(abs(x)).partition("e")
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(power or 0)
    bare = (whole + part).lstrip("0")
    point -= len(whole + part) - len((whole + part).lstrip("0"))
    bare = bare.rstrip("0") or "0"
    if -6 < point <= 21:
        if point <= 0:
            return f"{sign}0.{'0' * -point}{bare}"
        return sign + (bare.ljust(point, "0") if len(bare) <= point else f"{bare[:point]}.{bare[point:]}")
    mantissa = bare[0] + (f".{bare[1:]}" if len(bare) > 1 else "")
    return f"{sign}{mantissa}e{'+' if point > 0 else '-'}{abs(point - 1)}"


def _string(s: str) -> str:
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(s, ensure_ascii=False))


def dump(value) -> str:
    """Compact JSON text; lone surrogates escaped, other characters as they are."""
    if isinstance(value, str):
        return _string(value)
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, int | float):
        return number(float(value))
    if isinstance(value, list):
        return f"[{','.join(map(dump, value))}]"
    keys = value
    if any(map(_index, value)):  # keys that are array indices come first, by size
        keys = [*sorted(filter(_index, value), key=int), *(k for k in value if not _index(k))]
    return "{" + ",".join(f"{_string(k)}:{dump(value[k])}" for k in keys) + "}"


def _index(key: str) -> bool:
    return key.isascii() and key.isdigit() and (key == "0" or key[0] != "0") and int(key) < (1 << 32) - 1


def width(s: str) -> int:
    """UTF-8 bytes; a lone surrogate is written as the three bytes of U+FFFD."""
    return len(s.encode("utf-8", "surrogatepass"))


def shed(value, most: int):
    """Every string value over ``most`` bytes, at any depth, cut to ``most`` UTF-16 units and marked."""
    if isinstance(value, str):
        if width(value) <= most:
            return value
        head = value.encode("utf-16-le", "surrogatepass")[: 2 * most].decode("utf-16-le", "surrogatepass")
        return f"{head}{MARK[0]}{width(value) - width(head)}{MARK[1]}"
    if isinstance(value, list):
        return [shed(v, most) for v in value]
    if isinstance(value, dict):
        return {k: shed(v, most) for k, v in value.items()}
    return value


def fit_record(text: str, request: int, first: int, second: int) -> tuple[str, int]:
    """A record over its budget, cut once or, where still over the request's, once more."""
    value = shed(parse(text), first)
    out = dump(value)
    if width(out) > request:
        out = dump(shed(value, second))
    return out, width(out)


#: Bytes of records that are parsed and cut at once.
CUT_BYTES = 2 << 20


def fit_records(request: int, first: int, second: int):
    """``fit_record`` over columns; null in, null out. Of a batch, some megabytes of records at a time are Python objects."""

    @F.arrow_udf("record string, wire_bytes long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for raw in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            s = 0
            while s < len(raw):
                before = sizes[s - 1] if s else 0
                e = max(s + 1, int(np.searchsorted(sizes, before + CUT_BYTES, side="right")))
                rows = [(None, None) if x is None else fit_record(x, request, first, second) for x in raw.slice(s, e - s).to_pylist()]
                yield pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["record", "wire_bytes"])
                s = e
            if not len(raw):
                yield pa.StructArray.from_arrays([pa.array([], pa.string()), pa.array([], pa.int64())], names=["record", "wire_bytes"])

    return run


@F.pandas_udf(T.StringType())
def compacted(raw: pd.Series) -> pd.Series:
    """Records as serialising their values gives them; null in, null out."""
    return pd.Series([None if x is None else dump(parse(x)) for x in raw], dtype=object)


_LOOK = T.StructType([T.StructField(n, T.StringType()) for n in ("uuid", "cwd", "git_branch")] + [T.StructField("valid", T.BooleanType())])


@F.pandas_udf(_LOOK)
def second_look(raw: pd.Series) -> pd.DataFrame:
    """Lines that the built-in check refuses, parsed strictly; null in, null out."""
    rows = []
    for x in raw:
        if x is None:
            rows.append((None, None, None, None))
            continue
        try:
            v = parse(x)
        except ValueError:
            rows.append((None, None, None, False))
            continue
        get = lambda k, v=v: v[k] if isinstance(v, dict) and isinstance(v.get(k), str) and v[k] else None
        rows.append((get("uuid"), get("cwd"), get("gitBranch"), True))
    return pd.DataFrame(rows, columns=["uuid", "cwd", "git_branch", "valid"])


def chunk_numbers(sizes: np.ndarray, budget: int, records: int) -> np.ndarray:
    """Greedy chunks in order: as many records as fit the budget and the count, one at least."""
    ends = np.cumsum(sizes)
    out = np.zeros(len(sizes), np.int64)
    start = chunk = 0
    while start < len(sizes):
        done = int(ends[start - 1]) if start else 0
        stop = min(max(int(np.searchsorted(ends, done + budget, side="right")), start + 1), start + records)
        out[start:stop] = chunk
        start, chunk = stop, chunk + 1
    return out


def packer(budget: int, records: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("line_no", ignore_index=True)
        return pd.DataFrame({"file_path": group.file_path, "line_no": group.line_no, "chunk_no": chunk_numbers(group.wire_bytes.to_numpy(), budget, records)})

    return run


def exits(sizes: np.ndarray, own: int, budget: int, records: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a chunk that begins at each of the first ``records`` places: where the first chunk begins that begins at ``own`` or beyond, and how many begin before.

    ``sizes``: of the segment's ``own`` records, and of those behind it that a chunk of the segment may reach. Jumps from a chunk to the next one are
    composed by doubling.
    """
    before = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(own)
    after = np.searchsorted(before, before[at] + budget, side="right") - 1
    jump = np.minimum(np.maximum(after, at + 1), at + records)
    steps = np.ones(own, np.int64)
    while (inside := jump < own).any():
        to = jump[inside]
        steps[inside] += steps[to]
        jump[inside] = jump[to]
    return jump[:records], steps[:records]


def segment_exits(budget: int, records: int, segment: int):
    def run(group: pa.Table) -> pa.Table:
        at = group["at"].to_numpy()
        order = np.argsort(at)
        own = int((at < segment).sum())
        jump, steps = exits(group["wire_bytes"].to_numpy()[order], own, budget, records)
        cols = [group["file_path"][:1], group["seg"][:1], pa.array([own]), pa.array([(jump - own).astype("<i8").tobytes()]), pa.array([steps.astype("<i8").tobytes()])]
        return pa.table(cols, names=["file_path", "seg", "own", "jump", "steps"])

    return run


def entries(group: pa.Table) -> pa.Table:
    """Where in each segment of a file its first chunk begins, and that chunk's number: one look for each segment."""
    order = np.argsort(group["seg"].to_numpy())
    at, chunk, out = 0, 0, []
    for k in order.tolist():
        own = group["own"][k].as_py()
        out.append((group["seg"][k].as_py(), at, chunk))
        if at < own:
            jump, steps = (np.frombuffer(group[c][k].as_py(), "<i8")[at] for c in ("jump", "steps"))
            at, chunk = int(jump), chunk + int(steps)
        else:  # a chunk of an earlier segment goes on beyond this one
            at -= own
    segs, places, chunks = zip(*out, strict=True)
    return pa.table({"file_path": pa.array([group["file_path"][0].as_py()] * len(out)), "seg": pa.array(segs, pa.int64()), "first": pa.array(places, pa.int64()), "chunk": pa.array(chunks, pa.int64())})


def segment_packer(budget: int, records: int):
    def run(rows: pa.Table, entry: pa.Table) -> pa.Table:
        order = np.argsort(rows["at"].to_numpy())
        rows = rows.take(pa.array(order))
        first, chunk = entry["first"][0].as_py(), entry["chunk"][0].as_py()
        # what comes before the first chunk that begins here belongs to the one before it
        own = np.full(rows.num_rows, chunk - 1, np.int64)
        own[first:] = chunk + chunk_numbers(rows["wire_bytes"].to_numpy()[first:], budget, records)
        return pa.table({"file_path": rows["file_path"], "line_no": rows["line_no"], "chunk_no": pa.array(own)})

    return run
