"""Keeping records and requests within their size budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.helpers import entries, fit_records, packer, segment_exits, segment_packer

#: Defaults of the budgets, in bytes, and of the records in a request (fixed values).
REQUEST_BYTES = 3_500_000
RECORD_BYTES = 3_000_000
FIRST_CAP = 131_072
SECOND_CAP = 8_192
REQUEST_RECORDS = 1_000
#: Records of a file that one task packs.
SEGMENT_RECORDS = 2_000_000


def prepare_records(records: DataFrame, record_bytes: int = RECORD_BYTES, request_bytes: int = REQUEST_BYTES, first_cap: int = FIRST_CAP, second_cap: int = SECOND_CAP) -> DataFrame:
    """Cut the long strings of records over ``record_bytes``; ``record``, ``wire_bytes`` and ``shed`` for all.

    ``records``: their compact text as record (or, where there is none, as raw), and its wire_bytes. If a cut record is still over ``request_bytes`` it is cut again, shorter. Only oversized records
    reach Python. ``shed`` marks what was over the budget, changed or not.
    """
    over = F.col("shed")
    text = F.col("record" if "record" in records.columns else "raw")
    cut = fit_records(request_bytes, first_cap, second_cap)(F.when(over, text))
    return (
        records.withColumn("shed", F.col("wire_bytes") > record_bytes)
        .withColumn("cut", cut)
        .withColumn("record", F.when(over, F.col("cut.record")).otherwise(text))
        .withColumn("wire_bytes", F.when(over, F.col("cut.wire_bytes")).otherwise(F.col("wire_bytes")).cast("long"))
        .drop("cut", "raw")
    )


def pack_chunks(prepared: DataFrame, request_bytes: int = REQUEST_BYTES, request_records: int = REQUEST_RECORDS, segment: int = SEGMENT_RECORDS) -> DataFrame:
    """file_path, line_no, chunk_no: chunks in record order, each within both limits or of one record.

    A file's narrow rows (no payload) are packed together: greedy cuts depend on all earlier ones. A file of over ``segment`` records is
    packed in segments by as many tasks: each works out where a chunk would lead that begins at any of its first places, a walk over these small tables
    finds where one does, and then each numbers its own.
    """
    narrow = prepared.select("file_path", "line_no", "wire_bytes")
    large = narrow.groupBy("file_path").count().where(F.col("count") > segment).select("file_path")
    schema = "file_path string, line_no long, chunk_no long"
    if large.isEmpty():
        return narrow.groupBy("file_path").applyInPandas(packer(request_bytes, request_records), schema)
    small = narrow.join(large, "file_path", "left_anti").groupBy("file_path").applyInPandas(packer(request_bytes, request_records), schema)
    return small.unionByName(_pack_segments(narrow.join(large, "file_path", "left_semi"), request_bytes, request_records, max(segment, request_records), schema))


def _pack_segments(narrow: DataFrame, budget: int, records: int, segment: int, schema: str) -> DataFrame:
    # a record's place in its file: its place in a stretch of lines, after all stretches before
    lined = narrow.withColumn("stretch", F.floor(F.col("line_no") / segment))
    place = F.row_number().over(Window.partitionBy("file_path", "stretch").orderBy("line_no")) - 1
    ahead = F.sum("n").over(Window.partitionBy("file_path").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    sizes = lined.groupBy("file_path", "stretch").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(ahead, F.lit(0))).drop("n")
    placed = lined.withColumn("place", place).join(sizes, ["file_path", "stretch"]).withColumn("place", F.col("place") + F.col("ahead"))
    cut = placed.select("file_path", "line_no", "wire_bytes", F.floor(F.col("place") / segment).alias("seg"), (F.col("place") % segment).alias("at"))
    # a segment also sees what lies behind it as far as a chunk may reach
    behind = cut.where((F.col("at") < records) & (F.col("seg") > 0)).withColumn("seg", F.col("seg") - 1).withColumn("at", F.col("at") + segment)
    tables = cut.unionByName(behind).groupBy("file_path", "seg").applyInArrow(segment_exits(budget, records, segment), "file_path string, seg long, own long, jump binary, steps binary")
    begins = tables.groupBy("file_path").applyInArrow(entries, "file_path string, seg long, first long, chunk long")
    return cut.groupBy("file_path", "seg").cogroup(begins.groupBy("file_path", "seg")).applyInArrow(segment_packer(budget, records), schema)


def assemble_chunks(prepared: DataFrame, chunks: DataFrame) -> DataFrame:
    """file_path, chunk_no, n_records, chunk_bytes and records in order; as large as a request may be."""
    rows = prepared.join(chunks, ["file_path", "line_no"])
    return (
        rows.groupBy("file_path", "chunk_no")
        .agg(F.count("*").alias("n_records"), F.sum("wire_bytes").alias("chunk_bytes"), F.array_sort(F.collect_list(F.struct("line_no", "record"))).alias("rows"))
        .select("file_path", "chunk_no", "n_records", "chunk_bytes", F.col("rows.record").alias("records"))
    )
