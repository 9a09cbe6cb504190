"""Overlaps of sets counted by bitmaps, without pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.stores import written


def numbered(ids: DataFrame, column: str = "id") -> DataFrame:
    """``id, number``: distinct ids numbered from 1, by pieces of a hash, so that no task sorts them all."""
    rows = ids.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("_piece", F.pmod(F.xxhash64(column), F.lit(4096)))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("_piece").agg(F.count("*").alias("n")).select("_piece", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("_piece").orderBy(column))
    return rows.withColumn("_own", own).join(starts, "_piece").select(column, (F.col("before") + F.col("_own")).alias("number"))


def overlap(left: DataFrame, right: DataFrame, on: str, key: str) -> DataFrame:
    """``key, n, first``: how many rows of ``right`` share an element of their arrays ``on`` with a row of ``left``, and the first of their ids.

    The ids of ``right`` are numbered and held as bitmaps by element, 32,768 of them in
    4 KB.  A row of ``left`` meets the bitmaps of its elements and counts the bits
    of their union, so what is shuffled doesn't grow with the pairs that overlap.  Rows
    that share nothing are left out; null elements match nothing.
    """
    elements = right.select("id", F.explode(F.array_distinct(on)).alias("x")).filter("x is not null and id is not null")
    bits = written(elements.join(numbered(right), "id").groupBy("x", F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"), F.min("id").alias("first")), "bitmaps")
    mine = left.select(key, F.explode(F.array_distinct(on)).alias("x")).distinct()
    united = mine.join(bits, "x").groupBy(key, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), F.min("first").alias("first"))
    return united.groupBy(key).agg(F.sum(F.bitmap_count("bits")).alias("n"), F.min("first").alias("first"))
