"""Contiguous shards of near-equal bytes, by global prefix sums from per-partition totals.

DataFrame functions only.  Rows are range-partitioned by id; the totals of the partitions
(one row each) give every partition its offset, a window inside each partition gives every
row the bytes before it, and equal cuts of the grand total give the shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_width


def balanced_shards(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, overhead: int = 8) -> DataFrame:
    """Assign each row a ``shard`` (0 to ``shards`` - 1) and a gapless ``slot`` in it, in order of the id.

    Returns the id column, ``size`` (UTF-8 bytes of the text plus ``overhead``), ``text_crc32``, ``shard``
    and ``slot``.  A row goes where the middle of its byte range falls, so shard sizes differ by one row's
    size at most.

    Defined cases: a null or empty text has ``overhead`` bytes and checksum 0; null ids come first; equal ids
    are ordered by size and checksum, and identical rows are interchangeable; one row larger than a shard
    fills it alone and may leave neighbours empty; an empty table gives an empty result; other columns are
    not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + overhead).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    # fixed before it is cut up: the ranges are sampled, and one run must see one set of them
    rows = materialise(rows.withColumn("tie", F.monotonically_increasing_id()), "shard-sizes")
    order = ["id", "size", "text_crc32", "tie"]
    ranged = materialise(rows.repartitionByRange(shuffle_width(spark), *order).withColumn("part", F.spark_partition_id()), "shard-ranges")

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    totals = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(Window.partitionBy()).alias("total"))

    inside = Window.partitionBy("part").orderBy(*order)
    middle = 2 * (F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))) - F.col("size")
    placed = (
        ranged.join(F.broadcast(totals), "part")  # as many rows as partitions
        .select(
            "id", "size", "text_crc32",
            (F.col("rows_before") + F.row_number().over(inside) - 1).alias("index"),
            middle.alias("middle"), "total",
        )
        .withColumn("shard", F.expr(f"int(least({shards - 1}, (middle * {shards}) div (2 * total)))"))
    )
    firsts = placed.groupBy("shard").agg(F.min("index").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("index") - F.col("first")).alias("slot"))  # one row a shard
