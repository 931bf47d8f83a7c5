"""Operator 10 [native]: exact dedup by progressive refinement.

Rows are grouped by byte length, then by a hash of the first characters, then by the SHA-256 of the whole text. What survives a
step reaches the next scan as a bitmap (no text is shuffled), whose size follows the number of surviving groups up to a bound: rows outside it
are alone in their group for certain, and only the others have their whole content hashed. Beyond the bound (8 million groups) ever more rows
have their content hashed; the result stays the same.

Defined results: a null text counts as empty; equal means equal after lower-casing A-Z; of equal texts the largest doc_id stays
(null ids rank lowest; of rows that tie, one stays); an empty table gives an empty result; other columns are carried as they are,
whatever their names, except that keep_id, group_size and kept of `exact_groups` take the place of columns with these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bitmap_bits, hash128, join_hot, mark_survivors, scratch, stored, survivor_bitmap

PREFIX = 64  #: code points in the prefix hash


def normalised(text: str = "text") -> Column:
    return ascii_lower(F.coalesce(F.col(text), F.lit("")))


def refined(rows: DataFrame) -> DataFrame:
    """rows (_row, _text, _id) with `_full`: the SHA-256 of the normalised text where the row may have an equal, else null."""
    folder = scratch(rows.sparkSession)
    bare = F.coalesce(F.col("_text"), F.lit(""))
    rows = rows.withColumn("_size", F.octet_length(bare).cast("long")).withColumn("_slot", F.xxhash64("_size"))
    rows = _repeated(rows, F.lit(True), "_same_size", folder)
    head = ascii_lower(F.substring(bare, 1, PREFIX))
    rows = rows.withColumn("_slot", F.when(F.col("_same_size"), F.xxhash64("_size", head)))
    rows = _repeated(rows, F.col("_same_size"), "_same_head", folder)
    full = F.when(F.col("_same_size") & F.col("_same_head"), F.sha2(normalised("_text").cast("binary"), 256))
    return rows.withColumn("_full", full).drop("_size", "_slot", "_same_size", "_same_head")


def _repeated(rows: DataFrame, among: Column, flag: str, folder: str) -> DataFrame:
    """rows with a flag: whether their _slot may be that of another row too."""
    twice = stored(rows.where(among).groupBy("_slot").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_slot"), folder, flag)
    bits = bitmap_bits(twice.count())
    return mark_survivors(rows, "_slot", survivor_bitmap(twice, "_slot", bits), flag, bits)


def wrapped(docs: DataFrame, text: str, doc_id: str, columns: list[str]) -> DataFrame:
    """The columns in one struct, so that no name of theirs can meet one of the operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col(f"`{text}`").alias("_text"), F.col(f"`{doc_id}`").alias("_id"))


def unwrapped(columns: list[str]) -> list[Column]:
    return [F.col("_row").getField(c).alias(c) for c in columns]


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: the carried columns (default: the id), keep_id, group_size and kept."""
    spark = docs.sparkSession
    carry = carry or [doc_id]
    rows = refined(wrapped(docs, text, doc_id, carry)).select("_row", "_id", "_full", F.monotonically_increasing_id().alias("_uid"))
    rows = stored(rows, scratch(spark), "refined")  # narrow; fixes _uid
    best = rows.where("_full is not null").groupBy("_full").agg(F.max(F.struct("_id", "_uid")).alias("_best"), F.count(F.lit(1)).alias("_n"))
    h1, h2 = hash128(F.coalesce("_full", F.col("_uid").cast("string")))
    keyed = rows.withColumn("_h1", h1).withColumn("_h2", h2)
    right = best.withColumn("_h1", F.xxhash64("_full")).withColumn("_h2", hash128(F.col("_full"))[1]).select("_h1", "_h2", "_best", "_n").where("_n > 1")
    out = join_hot(keyed, right, ["_h1", "_h2"], "_n", rows.count())
    alone = F.col("_n").isNull()
    return out.select(
        *unwrapped([c for c in carry if c not in ("keep_id", "group_size", "kept")]),
        F.when(alone, F.col("_id")).otherwise(F.col("_best._id")).alias("keep_id"),
        F.coalesce(F.col("_n"), F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_best._uid") == F.col("_uid"))).alias("kept"),
    )


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with their columns. Only rows that may have an equal are shuffled."""
    rows = refined(wrapped(docs, text, doc_id, docs.columns))
    groups = rows.where("_full is not null").groupBy("_full").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    out = unwrapped(docs.columns)
    sure = rows.where("_full is null").select(*out)
    copies = rows.where("_full is not null").select("_row", "_id", "_full")
    joined = join_hot(copies, groups, ["_full"], "_n", docs.count())
    alone = joined.where("_n is null").select(*out)
    best = joined.where(F.col("_n").isNotNull() & F.col("_id").eqNullSafe(F.col("_keep"))).dropDuplicates(["_full"]).select(*out)
    return sure.unionByName(alone).unionByName(best)
