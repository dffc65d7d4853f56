"""Contiguous shards of near equal bytes, by global prefix sums.

Rows are dealt to partitions by ranges of doc_id and each partition's bytes and rows are summed;
prefix sums over those totals (a row for each partition) place every row on one line of bytes,
which is cut at equal targets. A row belongs to the shard in which its middle byte lies, so
no shard is off its target by more than a row. DataFrame operations only.

Defined results: null text has no bytes (size 8, crc32 0); rows with equal doc_id are ordered by
size, then crc32; a null doc_id comes first; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, written

#: Bytes that a row takes besides its text.
ROW_BYTES = 8


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row for each row of `docs`."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    order = ["doc_id", "size", "text_crc32"]
    # Written, since the ranges that Spark draws need not be the same when it draws them again.
    ranged = written(slim.repartitionByRange(partitions(docs.sparkSession), *order).withColumn("part", F.spark_partition_id()), "ranged")
    line = Window.orderBy("part")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    totals = totals.select("part", (F.sum("bytes").over(line) - F.col("bytes")).alias("bytes_before"), (F.sum("rows").over(line) - F.col("rows")).alias("rows_before"), F.sum("bytes").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_bytes"))
    within = Window.partitionBy("part").orderBy(*order)
    running = within.rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumns({"bytes_here": F.sum("size").over(running) - F.col("size"), "row_here": F.row_number().over(within) - 1})
    # The totals have a row for each partition, whatever the number of documents.
    placed = placed.join(F.broadcast(totals), "part").select(
        *order,
        F.expr(f"least({shards - 1}L, ((2 * (bytes_before + bytes_here) + size) * {shards}L) div (2 * all_bytes))").cast("int").alias("shard"),
        (F.col("rows_before") + F.col("row_here")).alias("row"),
    )
    placed = written(placed, "placed")
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))  # at most `shards` rows
    return placed.join(F.broadcast(firsts), "shard").select(*order, F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
