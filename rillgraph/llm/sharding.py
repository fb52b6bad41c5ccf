"""Balanced contiguous shards (operator 4), DataFrame functions alone.

Documents stand in one global order (id, size, checksum). Sizes are summed per
range partition; the few totals give each partition its offset, and a running
sum inside the partition gives each document its place in the global byte
stream. The stream is cut at equal targets, so shards are contiguous and their
bytes near equal: no shard is off by more than its largest document.

Defined results. A null text has no bytes and checksum 0. A null id sorts last.
Rows that agree in all three order columns are interchangeable: each gets a
place of its own. An empty table gives an empty result. Other columns are not
looked at.

Scale: two shuffles of four narrow columns (range, then by range number); the
text never moves. Ties are broken by the row's place in the scan, so repeated
ids spread over range partitions. The only broadcast has a row per range
partition or per shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_bytes, written

#: Bytes that every document takes besides its text.
OVERHEAD = 8


def shard_by_bytes(docs: DataFrame, n_shards: int, *, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """id_col, size, text_crc32, shard (0-based) and slot (gapless in a shard)."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written, so that finding the ranges and dealing by them read four narrow columns and not the texts.
    rows = written(
        docs.select(
            F.col(id_col).alias("id"),
            (text_bytes(text_col) + OVERHEAD).alias("size"),
            F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("tie"),
        )
    )
    order = [F.col("id").asc_nulls_last(), F.col("size"), F.col("text_crc32"), F.col("tie")]
    # Written, so that range numbers can't change between the two uses below.
    ranged = written(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_size"), F.count(F.lit(1)).alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "part",
        F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_size").over(Window.partitionBy(F.lit(1))).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    placed = (
        ranged.withColumns({"upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(inside)})
        .join(F.broadcast(starts), "part")
        .select(
            "id",
            "size",
            "text_crc32",
            # the shard in which the document's middle byte lies
            F.least(F.lit(n_shards - 1), F.floor((F.col("size_before") + F.col("upto") - F.col("size") / 2) * F.lit(float(n_shards)) / F.col("total"))).cast("int").alias("shard"),
            (F.col("rows_before") + F.col("nth") - 1).alias("place"),
        )
    )
    placed = written(placed)
    first = F.broadcast(placed.groupBy("shard").agg(F.min("place").alias("first_place")))
    return placed.join(first, "shard").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("place") - F.col("first_place")).alias("slot"))
