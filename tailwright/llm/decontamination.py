"""Finding passages of test items in documents, by an FM-index for each block of documents.

The index is a table: a row holds the index of one block of texts, a few MB whatever the texts. Searching it for a set of test items
reads that table only; removal reads the documents again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, pieces
from .fm_index import ARRAYS, FMIndex
from .texts import NOT_ALNUM, placed_words, words_of

#: Words of an item in a row that make a window.
WINDOW = 10
#: Bytes of text of one block, and words of a longer text that one part of it has.
BLOCK_BYTES = 6 << 20
PART_WORDS = 1 << 20
#: Pairs of a window and its item that are searched in one go: the driver and each task hold so many.
SEARCH_PAIRS = 200_000

LISTS = ("doc_id", "text_key", "row", "n_words", "at", "length", "part", "parts")
INDEX = ", ".join(f"{c} array<long>" for c in LISTS) + ", size long, vocabulary binary, vocabulary_at binary, " + ", ".join(f"{a} binary" for a in ARRAYS)
FOUND = "doc_id long, text_key long, row long, n_words long, parts long, spans array<struct<start:long,stop:long>>, items array<string>"


def _texts_in_parts(counts: np.ndarray, most: int, overlap: int) -> tuple[np.ndarray, ...]:
    """text, first word, words, number of the part and of parts; a part reaches ``overlap`` words into the next."""
    parts = np.maximum(1, -(-counts // most))
    text = np.repeat(np.arange(len(counts)), parts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = number * most
    return text, at, np.minimum(counts[text] - at, most + overlap), number, parts[text]


def _indexing(overlap: int, part_words: int):
    def block(b: pa.RecordBatch) -> Iterator[dict]:
        words, starts = words_of(b.column("text").cast(pa.binary()), NOT_ALNUM)
        counts = np.diff(starts)
        text, at, length, number, parts = _texts_in_parts(counts, part_words, overlap)
        own = {c: b.column(c) for c in ("doc_id", "text_key", "row")}
        # long texts have blocks of their own, one for each part
        whole = np.flatnonzero(parts == 1)
        for some in [whole, *([k] for k in np.flatnonzero(parts > 1))]:
            some = np.asarray(some, np.int64)
            if not len(some):
                continue
            spots = np.concatenate([np.arange(starts[text[k]] + at[k], starts[text[k]] + at[k] + length[k]) for k in some]) if len(some) < len(text) else None
            here = (words if spots is None else words.take(pa.array(spots))).dictionary_encode()
            index = FMIndex.build(here.indices.to_numpy(zero_copy_only=False).astype(np.int64), length[some], len(here.dictionary))
            known = here.dictionary
            offsets = np.frombuffer(known.buffers()[1], np.int32)[: len(known) + 1]
            out = {c: own[c].take(pa.array(text[some])).to_pylist() for c in own}
            out |= {"n_words": counts[text[some]], "at": at[some], "length": length[some], "part": number[some], "parts": parts[some], "size": index.size}
            data = known.buffers()[2]
            yield out | {"vocabulary": data.to_pybytes()[: offsets[-1]] if data is not None else b"", "vocabulary_at": offsets.tobytes()} | index.arrays()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", rows=20_000, size=BLOCK_BYTES):
            for x in block(b):
                yield pa.RecordBatch.from_arrays([_cell(c, x[c]) for c in NAMES], names=NAMES)

    return run


NAMES = [c.strip().split()[0] for c in INDEX.split(", ")]


def _cell(name: str, value) -> pa.Array:
    return pa.array([value], pa.list_(pa.int64()) if name in LISTS else pa.int64() if name == "size" else pa.binary())


def build_index(docs: DataFrame, ws: Workspace, overlap: int = WINDOW - 1, part_words: int = PART_WORDS) -> DataFrame:
    """A table with an FM-index for each block of ``docs(doc_id, text)``; every row of docs is in it once, null texts as empty ones.

    Texts of over ``part_words`` words are indexed in parts, each reaching ``overlap`` words into the next, so no window of up to that and one word is lost.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.monotonically_increasing_id().alias("row"), "text")
    return ws.save(rows.mapInArrow(_indexing(overlap, part_words), INDEX), "index")


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            words, starts = words_of(b.column("text").cast(pa.binary()), NOT_ALNUM)
            items, text = b.column("item_id").to_pylist(), words.to_pylist()
            out: dict[tuple, None] = {}
            for k, item in enumerate(items):
                own = text[starts[k] : starts[k + 1]]
                for i in range(max(1, len(own) - window + 1) if own else 0):
                    out[(b" ".join(own[i : i + window]), item)] = None
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.binary()), pa.array([i for _, i in out], pa.string())], names=["phrase", "item"])

    return run


@dataclass
class Phrases:
    """Windows of test items: words as numbers in ``vocabulary``, aligned to the right, and the items of each."""

    vocabulary: pa.Array
    words: np.ndarray
    lengths: np.ndarray
    items: pa.Array
    item_at: np.ndarray  # windows' places in item_of
    item_of: np.ndarray

    @classmethod
    def of(cls, pairs: list[tuple[bytes, str | None]]) -> Phrases:
        """An item without id has windows, and no name."""
        phrases = {p: k for k, p in enumerate(dict.fromkeys(bytes(p) for p, _ in pairs))}
        split = [p.split(b" ") for p in phrases]
        vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for s in split for w in s))}
        width = max((len(s) for s in split), default=1)
        words = np.full((len(split), width), -1)
        for k, s in enumerate(split):
            words[k, width - len(s) :] = [vocabulary[w] for w in s]
        names = sorted({i for _, i in pairs if i is not None})
        number = {i: k for k, i in enumerate(names)}
        named = sorted({(phrases[bytes(p)], number[i]) for p, i in pairs if i is not None})
        at = np.searchsorted([p for p, _ in named], np.arange(len(split) + 1))
        return cls(pa.array(list(vocabulary), pa.binary()), words, np.array([len(s) for s in split], np.int64), pa.array(names, pa.string()), at, np.array([i for _, i in named], np.int64))


def _runs(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... of each run laid in a row."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - size, size) + np.repeat(at, size)


def matches(index: FMIndex, vocabulary: pa.Array, lengths: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merged spans (text, start, stop) and the items of each text (text, item), both in the order of texts."""
    known = pc.index_in(phrases.vocabulary, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
    words = np.where(phrases.words >= 0, known[phrases.words], -1)
    low, high = index.search(words, phrases.lengths)
    phrase = np.repeat(np.arange(len(low)), high - low)
    begin = index.locate(_runs(low, high - low))
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    text = np.searchsorted(starts, begin, side="right") - 1
    change = np.zeros(index.size + 1, np.int32)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + phrases.lengths[phrase], -1)
    inside = np.cumsum(change) > 0
    turn = np.flatnonzero(np.diff(np.concatenate([[False], inside])))
    opens, closes = turn[::2], turn[1::2]
    of = np.searchsorted(starts, opens, side="right") - 1
    seen = np.unique(text * len(low) + phrase) if len(text) else np.zeros(0, np.int64)
    seen_text, seen_phrase = np.divmod(seen, max(1, len(low)))
    size = phrases.item_at[seen_phrase + 1] - phrases.item_at[seen_phrase]
    item = phrases.item_of[_runs(phrases.item_at[seen_phrase], size)]
    pairs = np.unique(np.repeat(seen_text, size) * max(1, len(phrases.items)) + item)
    of_item, item = np.divmod(pairs, max(1, len(phrases.items)))
    return of, opens - starts[of], closes - starts[of], of_item, item


def _searching(phrases: Phrases):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                cell = {c: np.asarray(b.column(c)[r].values) for c in LISTS if c != "doc_id"}
                offsets = b.column("vocabulary_at")[r].as_buffer()
                vocabulary = pa.Array.from_buffers(pa.binary(), offsets.size // 4 - 1, [None, offsets, b.column("vocabulary")[r].as_buffer()])
                index = FMIndex.of(b.column("size")[r].as_py(), {a: b.column(a)[r].as_buffer() for a in ARRAYS})
                of, start, stop, of_item, item = matches(index, vocabulary, cell["length"], phrases)
                n = len(cell["row"])
                spans = pa.StructArray.from_arrays([pa.array(start + cell["at"][of]), pa.array(stop + cell["at"][of])], names=["start", "stop"])
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), spans)
                items = pa.ListArray.from_arrays(pa.array(np.searchsorted(of_item, np.arange(n + 1)).astype(np.int32)), phrases.items.take(pa.array(item)))
                plain = [b.column("doc_id")[r].values, *(pa.array(cell[c]) for c in ("text_key", "row", "n_words", "parts"))]
                yield pa.RecordBatch.from_arrays([*plain, spans, items], names=[c.split()[0] for c in FOUND.split(", ")])

    return run


def _merged(found: DataFrame) -> DataFrame:
    """One row for each row of documents, of the parts and of the searches that met it."""
    spans = found.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    before = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.when(F.col("start") <= F.max("stop").over(before), 0).otherwise(1)
    runs = spans.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(Window.partitionBy("row").orderBy("start", "stop")))
    merged = runs.groupBy("row", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    items = found.select("row", F.explode("items").alias("i")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("i")).alias("items"))
    plain = found.groupBy("row").agg(*(F.first(c).alias(c) for c in ("doc_id", "text_key", "n_words", "parts")))
    out = plain.join(merged, "row", "left").join(items, "row", "left")
    none = lambda c: F.coalesce(c, F.array().cast(found.schema[c].dataType))
    return out.select("doc_id", "text_key", "row", "n_words", "parts", none("spans").alias("spans"), none("items").alias("items"))


def search_index(index: DataFrame, items: DataFrame, ws: Workspace, window: int = WINDOW, pairs: int = SEARCH_PAIRS) -> DataFrame:
    """doc_id, text_key, row, n_words, spans (of words, merged) and items (ids as strings, sorted) of every row indexed.

    Windows are ``window`` words of an item in a row; a shorter item with a word is one window; an item without words or text has none. Repeated items
    count once, an item without id marks words under no name. Windows are searched in blocks of about ``pairs`` windows and items.
    """
    told = ws.save(
        items.select("text", F.col("item_id").cast("string").alias("item_id")).mapInArrow(_windows(window), "phrase binary, item string").distinct(), "windows"
    )
    blocks = -(-told.count() // pairs)
    if blocks <= 1:
        found = ws.save(index.mapInArrow(_searching(Phrases.of([(r.phrase, r.item) for r in told.collect()])), FOUND), "found")
        return found.where("parts = 1").unionByName(_merged(found.where("parts > 1"))).drop("parts")
    dealt = told.withColumn("block", F.pmod(F.xxhash64("phrase", "item"), F.lit(blocks)))
    found = []
    for k in range(blocks):
        block = Phrases.of([(r.phrase, r.item) for r in dealt.where(F.col("block") == k).collect()])
        found.append(ws.save(index.mapInArrow(_searching(block), FOUND), f"found{k}"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more.where("size(spans) > 0"))
    return _merged(every).drop("parts")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """doc_id, text_key, row, n_words, spans and items of every row of ``docs(doc_id, text)`` against ``items(item_id, text)``.

    Null, empty and wordless texts have no words and no spans; rows of one id are rows of their own; an empty table gives no rows; no items give no spans.
    """
    ws = Workspace(docs.sparkSession, "decontamination")
    return search_index(build_index(docs, ws, window - 1, part_words), items, ws, window)


def report(found: DataFrame) -> DataFrame:
    """Counts and a digest of the items of each row."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def _cutting(names: list[str], column: int, spans: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, names[column]):
            texts = b.column(column).cast(pa.binary())
            words, starts, places, data = placed_words(texts, NOT_ALNUM)
            ends = places + pc.binary_length(words).to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))])
            out = []
            for r, own in enumerate(b.column(spans).to_pylist()):
                if texts[r].is_valid:
                    keep = np.ones(at[r + 1] - at[r], bool)
                    for s in own or []:
                        keep[places[starts[r] + s["start"]] - at[r] : ends[starts[r] + s["stop"] - 1] - at[r]] = False
                    out.append(data[at[r] : at[r + 1]][keep].tobytes())
                else:
                    out.append(None)
            cols = [pa.array(out, pa.binary()).cast(pa.string()) if k == column else c for k, c in enumerate(b.columns[:spans])]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def remove_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents without the passages found in them; a span goes from its first word to the end of its last.

    Found spans meet rows by id and the hash of the text, nulls included; all other columns stay as they are.
    """
    spans = found.where("size(spans) > 0").select(F.col("doc_id").alias("_found_id"), F.col("text_key").alias("_found_key"), F.col("spans").alias("_found_spans")).dropDuplicates(["_found_id", "_found_key"])
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_found_id")) & (F.xxhash64("text") == F.col("_found_key"))
    joined = docs.join(spans, same, "left").select(*docs.columns, "_found_spans")
    return joined.mapInArrow(_cutting(docs.columns, docs.columns.index("text"), len(docs.columns)), docs.schema)
