"""Phrases of words that stand together more often than apart, counted by dynamic itemset counting.

The texts are cut into words once, and written as packed lists: the words of some texts, each once, and which of them stands where. The lists are
dealt into shards, which are scanned in turn, round after round. Words are counted from the first scan on. As soon as both
parts of a longer phrase (all words but the last, all but the first) have reached the threshold, the phrase is counted from the next scan on, whatever its length, and
until each shard was scanned once. Counts are packed arrays of hashed phrases, dealt by hash, so no phrase, however common, is more than one
number of a task; which phrases are in use is a table of fixed size. At the end frequent phrases get their words back; those that share a hash are
counted again by their words, so all counts are exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, give_back, mix64, parts_of, pieces, small_batches
from .texts import PIECE_ENDS, PIECE_GAPS, PRIME, placed_words, word_hashes

LEAST, LONGEST, TOP, COVERED = 30, 4, 2000, 80
SHARDS = 4
#: Slots of the table of phrases in use, a byte each; phrases that share a slot may start each other's longer phrases early, no more.
SLOT_BITS = 24
#: Bits of the filter for frequent phrases in the last scan.
FILTER_BITS = 26
#: Keys that a task holds before it sorts them, and counts before it hands them on.
HELD = 2 << 20
#: Bytes of input, by the planner's estimate, that one task scans: the more, the fewer times a common phrase is sent.
TASK_BYTES = 32 << 20
PIECE_BYTES = 1 << 20
PIECE_ROWS = 4000
#: Slots of what a task of the last scan has named; what finds no slot is named again.
SEEN_BITS = 22
#: A key: the hash, two bits of its length, five bits of the scan that its count began with.
LENGTH_AT, START = 5, np.uint64(31)
#: Partial lists of the best phrases of a language, from many to few.
SALTS = (64, 4)
OFF = 255

PACKED = "bucket int, keys binary, counts binary"
#: Texts as packed lists: languages and numbers of words of each text, the words that occur and their sizes, which of them stands at each place, and whether it goes on the piece of the one before.
LISTS = "langs array<string>, texts binary, words binary, sizes binary, places binary, follows binary"
_LISTS = [c.split()[0] for c in LISTS.split(", ")]
STATE = f"{PACKED}, done_keys binary, done_counts binary, reached binary"


def _sent(spark: SparkSession, table: np.ndarray):
    """A broadcast of a table of bytes, most of which are alike."""
    return spark.sparkContext.broadcast(zlib.compress(table.tobytes(), 1))


def _opened(sent) -> np.ndarray:
    return np.frombuffer(zlib.decompress(sent.value), np.uint8)


def _text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Texts of a few MB with their languages; a longer text is cut where a piece ends."""
    ends = PIECE_ENDS
    for b in pieces(batches, "text", PIECE_ROWS, PIECE_BYTES):
        lang, text = b.column("lang"), b.column("text").cast(pa.large_binary()).fill_null(b"")
        if b.num_rows > 1 or (n := len(text[0].as_py())) <= 2 * PIECE_BYTES:
            yield lang, text
            continue
        data, at = np.frombuffer(text[0].as_py(), np.uint8), 0
        while at < n:
            to, reach = min(n, at + PIECE_BYTES), 1 << 16
            while to < n and not len(cut := np.flatnonzero(ends[data[to : to + reach]])):
                to += reach
            to = min(n, to + int(cut[0]) + 1) if to < n else n
            yield lang, pa.array([data[at:to].tobytes()], pa.large_binary())
            at = to


def _packing(shards: int):
    """Texts as ``LISTS``, dealt to shards in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() if TaskContext.get() else 0
        for lang, text in _text_slices(batches):
            words, starts, begins, data = placed_words(text, PIECE_GAPS)
            known = words.dictionary_encode()
            places, offsets = known.indices.to_numpy(zero_copy_only=False), np.frombuffer(known.dictionary.buffers()[1], np.int32)[: len(known.dictionary) + 1]
            passed = np.cumsum(PIECE_ENDS[data], dtype=np.int32)[begins]
            follows = np.zeros(len(words) + 1, bool)
            follows[1:-1] = passed[1:] == passed[:-1]
            follows[starts] = False
            packs = [np.diff(starts).astype(np.int32), np.frombuffer(known.dictionary.buffers()[2] or b"", np.uint8)[: offsets[-1]], np.diff(offsets), places.astype(np.uint16 if len(offsets) <= 1 << 16 else np.int32), np.packbits(follows)]
            yield pa.RecordBatch.from_arrays([pa.array([lang.to_pylist()], pa.list_(pa.string())), *(pa.array([x.tobytes()], pa.binary()) for x in packs), pa.array([shard % shards], pa.int32())], names=[*_LISTS, "shard"])
            shard += 1

    return run


def _unpacked_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each list: languages and numbers of words of its texts, the words that occur, which of them stands where, whether it goes on the piece of the one before, and hashes of language and word."""
    give_back()
    for b in batches:
        for row in range(b.num_rows):
            langs = b.column("langs")[row].as_py()
            sizes, data, widths, places, follows = (b.column(c)[row].as_buffer() for c in _LISTS[1:])
            sizes, widths = np.frombuffer(sizes, np.int32), np.frombuffer(widths, np.int32)
            n = int(sizes.sum())
            places = np.frombuffer(places, np.uint16 if len(widths) < 1 << 16 else np.int32)
            follows = np.unpackbits(np.frombuffer(follows, np.uint8), count=n + 1).view(bool)
            words = pa.Array.from_buffers(pa.binary(), len(widths), [None, pa.py_buffer(np.append(0, np.cumsum(widths)).astype(np.int32)), data])
            tongue = word_hashes(pc.binary_join_element_wise(pa.scalar(b"l"), pa.array(langs, pa.string()).cast(pa.binary()), pa.scalar(b"")))
            hashes = mix64(word_hashes(words)[places] + np.repeat(tongue * PRIME, sizes))
            yield langs, sizes, words, places, follows, hashes


def _grams(hashes: np.ndarray, follows: np.ndarray, mask: np.uint64, since: Callable[[np.ndarray], np.ndarray], least: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """length, places, hashes and first scan of all phrases whose parts are in use; ``since`` has the scan from which a phrase is (OFF: not yet). Of the longest ones, whose extensions nobody asks for, those since scan ``least`` or later."""
    n = len(hashes)
    place, value, first = np.arange(n), hashes, np.zeros(n, np.uint8)
    yield 1, place, value, first
    for length in range(2, LONGEST + 1):
        used = np.full(n + 1, OFF, np.uint8)
        used[place] = np.maximum(since(value), first)  # a slot that others filled may be older than the phrase
        on = (used[place] != OFF) & (used[place + 1] != OFF)
        if length == 2:
            on &= follows[place + 1]
        if length == LONGEST and least:
            on &= np.maximum(used[place], used[place + 1]) >= least
        place, value = place[on], value[on]
        value = mix64(value * PRIME + hashes[place + length - 1] + np.uint64(length)) & mask
        first = np.maximum(used[place], used[place + 1])
        yield length, place, value, first


def _key(value: np.ndarray, length: int) -> np.ndarray:
    return (value & ~np.uint64(127)) | np.uint64((length - 1) << LENGTH_AT)


def _slot(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")  # quicker where sorted lists follow each other
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def _counting(scan: int, shards: int, table, bucket_bits: int, mask: np.uint64):
    """Counts of what is to be counted in this scan, packed by bucket."""

    def counted(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.sort(np.concatenate(held))
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[heads], np.diff(np.append(heads, len(keys)))

    def packed(sums: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, counts = _summed(np.concatenate([k for k, _ in sums]), np.concatenate([c for _, c in sums]))
        bucket = (keys >> np.uint64(64 - bucket_bits)).astype(np.int32)
        heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        spans = list(zip(heads, np.append(heads[1:], len(keys)), strict=True))
        return pa.RecordBatch.from_pydict({"bucket": bucket[heads], "keys": [keys[a:b].tobytes() for a, b in spans], "counts": [counts[a:b].tobytes() for a, b in spans]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = _opened(table)

        def since(value: np.ndarray) -> np.ndarray:
            return use[_slot(value)]

        held, sums, size, distinct = [], [], 0, 0
        for _, _, _, _, follows, hashes in _unpacked_lists(batches):
            for length, _, value, first in _grams(hashes & mask, follows, mask, since, max(0, scan - shards + 1)):
                now = first.astype(np.int16) + shards > scan
                keys = _key(value[now], length) | first[now].astype(np.uint64)
                held.append(keys)
                size += len(keys)
            if size > HELD:
                sums.append(counted(held))
                distinct += len(sums[-1][0])
                held, size = [], 0
                if distinct > 2 * HELD:
                    yield packed(sums)
                    sums, distinct = [], 0
        if size:
            sums.append(counted(held))
        if sums:
            yield packed(sums)

    return run


def _merging(scan: int, shards: int, bucket_bits: int, least: int):
    """The counts of a bucket after a scan: what is still counted, what was counted in all shards and is frequent, and the slots in use."""
    width = 1 << (SLOT_BITS - bucket_bits)

    def joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)

    def run(rows: pa.Table) -> pa.Table:
        keys, counts = _summed(joined(rows["keys"], np.uint64), joined(rows["counts"], np.int64))
        bucket = rows["bucket"][0].as_py()
        enough = counts >= least
        grows = enough & (((keys >> np.uint64(LENGTH_AT)) & np.uint64(3)) < LONGEST - 1)
        reached = np.zeros(width, bool)
        reached[_slot(keys[grows]) - bucket * width] = True
        over = (keys & START).astype(np.int64) + shards <= scan + 1
        done, open_ = over & enough, ~over
        packs = [keys[open_], counts[open_], np.append(joined(rows["done_keys"], np.uint64), keys[done]), np.append(joined(rows["done_counts"], np.int64), counts[done]), np.packbits(reached)]
        return pa.table([pa.array([bucket], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in packs)], names=[c.split()[0] for c in STATE.split(", ")])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k, c in zip(b.column("done_keys").to_pylist(), b.column("done_counts").to_pylist(), strict=True):
            yield pa.RecordBatch.from_pydict({"key": (np.frombuffer(k, np.uint64) >> np.uint64(LENGTH_AT)).astype(np.int64), "f": np.frombuffer(c, np.int64)})


def _probe(key: np.ndarray, k: int) -> np.ndarray:
    """The first, second or third place of a key in the filter of frequent phrases."""
    return ((mix64(key) >> np.uint64(19 * k)) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def _filtering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << FILTER_BITS, bool)
    for b in batches:
        for k in range(3):
            bits[_probe(b.column("key").to_numpy().view(np.uint64), k)] = True
    whole = np.packbits(bits, bitorder="little").reshape(256, -1)
    yield pa.RecordBatch.from_pydict({"block": np.arange(256, dtype=np.int32), "bits": [zlib.compress(x.tobytes(), 1) for x in whole]})


def _either(rows: pa.Table) -> pa.Table:
    bits = [np.frombuffer(zlib.decompress(x), np.uint8) for x in rows["bits"].to_pylist()]
    whole = bits[0].copy()
    for x in bits[1:]:
        whole |= x
    return pa.table({"block": rows["block"][:1].combine_chunks(), "bits": pa.array([whole.tobytes()], pa.binary())})


def _naming(table, bits, mask: np.uint64, once: bool):
    """Language, words and count of all that was counted under a key that may be frequent: each once in a task, or (not ``once``) with all its counts; and the words of each language, without key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, use = _opened(bits), _opened(table)

        def since(value: np.ndarray) -> np.ndarray:
            return use[_slot(value)]

        def frequent(key: np.ndarray) -> np.ndarray:
            at = np.arange(len(key))
            for k in range(3):
                p = _probe(key[at], k)
                at = at[(filled[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0]
            return at

        seen = np.zeros(1 << SEEN_BITS if once else 0, np.uint64)

        def fresh(second: np.ndarray) -> np.ndarray:
            """Where phrases stand that the task has not named, each once; they count as named from now on, as far as there are slots."""
            at = np.flatnonzero(seen[slots(second, 0)] != second)
            at = at[seen[slots(second[at], SEEN_BITS)] != second[at]]
            new, first = np.unique(second[at], return_index=True)
            full = seen[slots(new, 0)] != 0
            seen[slots(new[~full], 0)] = new[~full]
            seen[slots(new[full], SEEN_BITS)] = new[full]
            return at[first]

        def slots(second: np.ndarray, shift: int) -> np.ndarray:
            return ((second >> np.uint64(shift)) & np.uint64(len(seen) - 1)).astype(np.int64)

        total: dict[str, int] = {}
        for langs, sizes, words, places, follows, hashes in _unpacked_lists(batches):
            other = mix64(hashes ^ PRIME)
            for x, n in zip(langs, sizes.tolist(), strict=True):
                total[x] = total.get(x, 0) + n
            ends = np.cumsum(sizes)
            for length, place, value, _ in _grams(hashes & mask, follows, mask, since):
                key = _key(value, length) >> np.uint64(LENGTH_AT)
                on = frequent(key)
                key, place = key[on], place[on]
                if once:  # phrases that share a key are told apart by a second hash
                    on = fresh(mix64(key + sum(other[place + k] * PRIME ** np.uint64(k + 1) for k in range(length))) | np.uint64(1))  # 0: a free slot
                    key, place = key[on], place[on]
                if not len(key):
                    continue
                parts = [words.take(pa.array(places[place + k])) for k in range(length)]
                phrase = parts[0] if length == 1 else pc.binary_join_element_wise(*parts, b" ")
                own = pa.array(langs, pa.string()).take(pa.array(np.searchsorted(ends, place, side="right")))
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), own, phrase.cast(pa.string()), pa.array(np.ones(len(key), np.int64))], names=["key", "lang", "phrase", "f"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(total), pa.int64()), pa.array(list(total), pa.string()), pa.nulls(len(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["key", "lang", "phrase", "f"])

    return run


def count_phrases(docs: DataFrame, ws: Workspace, least: int = LEAST, shards: int = SHARDS, hash_bits: int = 57) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of one to four words found ``least`` times or more, and (lang, n) of all words."""
    if shards * (LONGEST - 1) > int(START):
        raise ValueError("too many shards for the five bits of a scan")
    spark = docs.sparkSession
    mask = np.uint64(((1 << hash_bits) - 1) << (64 - hash_bits))
    bucket_bits = min(20, max(5, (parts_of(docs) - 1).bit_length()))
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(_packing(shards), f"{LISTS}, shard int")
    task = spark.sparkContext.defaultParallelism
    estimate = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    rows.write.partitionBy("shard").parquet(f"{ws.path}/shards")
    lists = spark.read.schema(f"{LISTS}, shard int").parquet(f"{ws.path}/shards")
    of_shard, of_all = (max(task, min(estimate // n // TASK_BYTES, 1_000_000)) for n in (shards, 1))
    table = np.full(1 << SLOT_BITS, OFF, np.uint8)
    state, scan, last = spark.createDataFrame([], STATE), 0, 0
    while scan < last + shards:
        sent = _sent(spark, table)
        counted = lists.where(F.col("shard") == scan % shards).select(*_LISTS).coalesce(of_shard).mapInArrow(_counting(scan, shards, sent, bucket_bits, mask), PACKED)
        both = state.drop("reached").unionByName(counted, allowMissingColumns=True)
        state = ws.save(both.groupBy("bucket").applyInArrow(_merging(scan, shards, bucket_bits, least), STATE), f"scan{scan}")
        # a bit for each slot, however many phrases there are
        for r in state.select("bucket", "reached").collect():
            new = np.unpackbits(np.frombuffer(r.reached, np.uint8)).astype(bool)
            own = table[r.bucket * len(new) : (r.bucket + 1) * len(new)]
            new &= own == OFF
            if new.any():
                own[new] = scan + 1
                last = scan + 1
        sent.destroy()
        if scan:
            ws.drop(f"scan{scan - 1}")
        scan += 1
    frequent = ws.save(state.select("done_keys", "done_counts").mapInArrow(_unpacked, "key long, f long"), "frequent")
    ws.drop(f"scan{scan - 1}")
    blocks = frequent.select("key").mapInArrow(_filtering, "block int, bits binary").groupBy("block").applyInArrow(_either, "block int, bits binary").collect()
    bits = _sent(spark, np.frombuffer(b"".join(r.bits for r in sorted(blocks, key=lambda r: r.block)), np.uint8))
    sent = _sent(spark, table)
    schema = "key long, lang string, phrase string, f long"
    named = ws.save(lists.select(*_LISTS).coalesce(of_all).mapInArrow(_naming(sent, bits, mask, True), schema), "named")
    sizes = named.where("key is null").groupBy("lang").agg(F.sum("f").alias("n"))
    # dealt before they are grouped: a task has hardly a key twice
    name = named.where("key is not null").repartition("key").groupBy("key").agg(F.min(F.struct("lang", "phrase")).alias("name"), F.max(F.struct("lang", "phrase")).alias("other"))
    met = ws.save(frequent.join(name, "key").withColumn("alone", F.col("name") == F.col("other")), "met")
    out = met.where("alone").select("name.lang", "name.phrase", "f")
    shared = met.where("not alone").select("key").distinct()
    if not shared.isEmpty():
        again = lists.select(*_LISTS).coalesce(of_all).mapInArrow(_naming(sent, bits, mask, False), schema).join(shared, "key", "left_semi")
        out = out.unionByName(again.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least))
    return ws.save(out, "phrases"), sizes


def _part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def mine_phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED, shards: int = SHARDS, hash_bits: int = 57) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of ``docs(lang, text)``.

    Null texts are empty, a null language is ``und``; repeated rows count as often as they occur; an empty table, or one without frequent phrases, gives no rows.
    Ties are in order of counts, then of the phrase's bytes.
    """
    small_batches(docs.sparkSession)
    ws = Workspace(docs.sparkSession, "phrases")
    counts, sizes = count_phrases(docs, ws, least, shards, hash_bits)
    words = F.split("phrase", " ", -1)
    phrases = counts.where("instr(phrase, ' ') > 0").withColumn("w", words).withColumn("len", F.size("w")).withColumnRenamed("f", "a")
    # scores of all cuts
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("len") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("w"), F.lit(1), F.col("k")).alias("first"), _part(F.col("w"), F.col("k") + 1, F.col("len") - F.col("k")).alias("rest"))
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = F.expr("CAST((CAST(2000000 AS decimal(8,0)) * CAST(a AS decimal(20,0))) div (CAST(l AS decimal(20,0)) + CAST(r AS decimal(20,0))) AS BIGINT)")
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score)
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.*")
    # what longer phrases take with them
    inner = phrases.where("len > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("len") - 1))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("len") - F.col("m") + 1)))
    inside = inner.select("lang", _part(F.col("w"), F.col("i"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").where(f"longer is null or 100 * CAST(longer AS decimal(20,0)) < {covered} * CAST(a AS decimal(20,0))")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = kept.select("lang", "phrase", "score", "a", "l", "r", F.xxhash64("phrase").alias("h"))
    for salts in SALTS:
        dealt = Window.partitionBy("lang", "s").orderBy(*order)
        salted = salted.withColumn("s", F.pmod("h", F.lit(salts))).withColumn("at", F.row_number().over(dealt)).where(F.col("at") <= top).drop("s", "at")
    # so many lists of ``top`` at most are left of a language
    lists = salted.groupBy("lang").agg(F.collect_list(F.struct((-F.col("score")).alias("x"), (-F.col("a")).alias("y"), "phrase", "l", "r")).alias("all")).join(sizes, "lang")
    ranked = lists.select("lang", "n", F.posexplode(F.slice(F.array_sort("all"), 1, top)).alias("at", "p"))
    return ranked.select("lang", (F.col("at") + 1).cast("long").alias("rank"), "p.phrase", (-F.col("p.y")).alias("a"), "p.l", "p.r", "n", (-F.col("p.x")).alias("score"))
