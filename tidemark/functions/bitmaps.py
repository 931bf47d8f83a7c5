"""Bitmaps of hashed keys: a small broadcast that tells which rows of a scan surely don't have one of many keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_A_KEY, MAX_BITS = 16, 27  #: bits for each key of a bitmap, and the power of two that bounds it: 16 MB


def bits_for(keys: int, most: int = MAX_BITS) -> int:
    """The power of two for a bitmap of so many keys: one in sixteen bits is set at most, until the bound is reached at 8 million keys. Beyond
    that more and more keys look as if they were in it; that costs time, never a result."""
    return min(most, max(15, (BITS_A_KEY * keys - 1).bit_length()))


def survivor_bitmap(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """2**bits bits in 4 KB pieces, set where a key's hash falls."""
    slot = F.pmod(F.col(key), F.lit(1 << bits))
    return (keys.select(F.bitmap_bucket_number(slot).alias("_piece"), F.bitmap_bit_position(slot).alias("_bit"))
            .groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_bits")))


def mark_survivors(df: DataFrame, key: str, bitmap: DataFrame, flag: str, bits: int) -> DataFrame:
    """Adds flag: false means that the key is surely not in the bitmap's keys; true that it may be."""
    slot = F.pmod(F.col(key), F.lit(1 << bits))
    looked = df.withColumn("_piece", F.bitmap_bucket_number(slot)).withColumn("_bit", F.bitmap_bit_position(slot)).join(F.broadcast(bitmap), "_piece", "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.expr("cast(_bit % 8 as int)")
    return looked.withColumn(flag, F.coalesce(F.call_function("shiftright", byte, hit).bitwiseAND(F.lit(1)) == 1, F.lit(False))).drop("_piece", "_bit", "_bits")
