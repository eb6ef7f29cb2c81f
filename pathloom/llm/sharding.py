"""Contiguous shards of nearly equal bytes: global prefix sums of sizes from per-partition totals, cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm._common import durable, text_of


def shard_by_bytes(rows: DataFrame, shards: int, order_by: list[str], size_col: str = "size") -> DataFrame:
    """``rows`` with shard (0 to shards-1) and slot (its place in the shard, gapless from 0).

    In the order of ``order_by``, the row whose byte interval has its middle in the k-th of ``shards`` equal parts of
    all bytes lies in shard k. So shards are contiguous and differ from the target by about the size of one row. Ties
    of ``order_by`` (repeated rows) are put in some fixed order. Null sizes count as 0; an empty table stays empty. One
    range exchange, of these columns alone; the totals of partitions are all that meets in one place.
    """
    kept = durable(
        rows.repartitionByRange(*[F.col(c) for c in order_by]).sortWithinPartitions(*order_by)
        .withColumn("_part", F.spark_partition_id().cast("long")).withColumn("_row", F.monotonically_increasing_id())
    )
    size = F.coalesce(F.col(size_col).cast("long"), F.lit(0))
    inside = Window.partitionBy("_part").orderBy("_row")
    totals = kept.groupBy("_part").agg(F.sum(size).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    over = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    totals = totals.select("_part", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_bytes_before"), F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_rows_before"), F.sum("_sum").over(Window.partitionBy()).alias("_total"))
    placed = (
        kept.withColumn("_end", F.sum(size).over(inside)).withColumn("_at", F.row_number().over(inside) - 1)
        .join(totals, "_part")
        .withColumn("_double_middle", 2 * (F.col("_bytes_before") + F.col("_end")) - size)
        .withColumn("shard", F.expr(f"cast(least({shards - 1}, if(_total = 0, 0, cast(_double_middle as decimal(38,0)) * {shards} div (2 * _total))) as int)"))
        .withColumn("_global", F.col("_rows_before") + F.col("_at"))
    )
    placed = placed.select(*rows.columns, "shard", "_global")
    # a shard is contiguous: its first row's global number is the offset of its slots; a row for each shard
    first = placed.groupBy("shard").agg(F.min("_global").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(*rows.columns, "shard", (F.col("_global") - F.col("_first")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row: contiguous in doc_id (nulls first).

    Size: UTF-8 bytes of the text (null: none) plus 1, so it is never 0. Texts themselves are not moved.
    """
    text = text_of(docs, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    out = shard_by_bytes(rows, shards, ["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
