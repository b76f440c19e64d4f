"""Contiguous shards of nearly equal bytes, from global prefix sums.

The rows (without their texts) are range-partitioned by id and kept as a table with their partition number, so that the
numbering is fixed. Each partition's total gives the bytes in front of it; a running sum inside the partition completes
the prefix sum of every row. A row goes to the shard in which its first byte falls when the whole is cut at equal
targets, so shards are contiguous in id order and differ by less than one row's size. Only the totals, one row per
partition, ever meet in one task.

Defined cases: a null text has size 1 and the checksum of the empty text; a null doc_id sorts first; repeated rows are
placed one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.llm.common import stored, text_or_empty

LAW = "bytes"


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    order = ["doc_id", "size", "text_crc32"]
    rows = docs.select("doc_id", (F.octet_length(text_or_empty()).cast("bigint") + 1).alias("size"), F.crc32(text_or_empty().cast("binary")).alias("text_crc32"))
    rows = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    placed = rows.select(*order, "part", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.row_number().over(inside).alias("nth"))
    # one row per range partition: bounded by the number of partitions, not by the data
    placed = placed.join(F.broadcast(totals), "part")
    placed = placed.select(*order, F.expr(f"cast({shards} * cast(bytes_before + upto - size as decimal(30, 0)) div all_bytes as int)").alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("row"))
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # as many rows as shards
    return placed.join(F.broadcast(first), "shard").select(
        *order, F.lit(LAW).alias("law"), "shard", (F.col("row") - F.col("first")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
