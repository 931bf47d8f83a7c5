"""Comparison by range digests: ranges of the key whose sums are equal aren't opened.

A digest table has, for each range of the key, the number of rows and two order-free sums of their 128-bit hashes, and the same for groups of FAN
ranges, and groups of those, up to one row for the table. Sums are added up map-side: a side is scanned once, and nothing but a row a range is shuffled. A
digest table can be saved and loaded, so that a table that stays need not be scanned again; ranges that differ are found from the top down, and only their
rows are read (by key bounds, which reach the Parquet or JDBC filter) and joined.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import column, literal, named, value_hash
from .diff import keyed, row_diff, shared_columns

FAN = 16  #: ranges in a group
RANGES = 1024


def bounds(df: DataFrame, keys: Sequence[str], ranges: int = RANGES) -> list[Row]:
    """Least keys of all ranges of about equal row counts but the first. Keys only are shuffled."""
    key = F.struct(*keyed(df, keys)).alias("k")
    each = df.select(key).repartitionByRange(ranges, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("low")).orderBy("low")
    return [r.low for r in each.collect()][1:]  # a row a range


def range_of(df: DataFrame, keys: Sequence[str], lows: Sequence[Row], like: DataFrame | None = None) -> Column:
    """The number of bounds that aren't greater than a row's key: found among every 32nd one or so first, then among those after it. Nulls come first."""
    if not lows:
        return F.lit(0)
    kinds = [named(df if like is None else like, k).dataType for k in keys]
    key = F.struct(*keyed(df, keys, like))
    step = max(1, math.isqrt(len(lows)))
    known = lambda some: F.array(*[F.struct(*[literal(v, kind).alias(k) for k, kind, v in zip(keys, kinds, r)]) for r in some])
    upto = lambda some: F.size(F.filter(some, lambda b: b <= key))
    coarse = upto(known(lows[step::step])) if len(lows) > step else F.lit(0)
    return coarse * step + upto(F.slice(known(lows), coarse * step + 1, F.lit(step)))


def digests(df: DataFrame, keys: Sequence[str], lows: Sequence[Row], columns: Sequence[str], like: DataFrame | None = None) -> DataFrame:
    """level, id, n, a, b: the digest of each range (level 0) that has rows, of each group of FAN of a level (the next), up to one for the table.

    With `like`, values and keys are taken as that table's types. Sums are of whole numbers, so they can't lose anything."""
    hashed = df.select(range_of(df, keys, lows, like).alias("id"), value_hash(df, [*keys, *columns], like.schema if like is not None else None).alias("h"))
    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).cast("decimal(38,0)").alias(c[-1])
    leaves = hashed.groupBy("id").agg(F.count(F.lit(1)).alias("n"), total("h.a"), total("h.b"))
    groups = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("id") / FAN**k).cast("int").alias("id")) for k in range(_height(len(lows) + 1) + 1)])
    every = leaves.select(F.explode(groups).alias("g"), "n", "a", "b").groupBy("g")
    return every.agg(*[F.sum(c).cast(k).alias(c) for c, k in (("n", "long"), ("a", "decimal(38,0)"), ("b", "decimal(38,0)"))]).select("g.level", "g.id", "n", "a", "b")


def _height(size: int) -> int:
    return 0 if size <= 1 else math.ceil(math.log(size, FAN) - 1e-9)


def save(df: DataFrame, path: str, keys: Sequence[str], ranges: int = RANGES, columns: Sequence[str] | None = None) -> None:
    """The digests of a table and their bounds, as Parquet at a path."""
    columns = [c for c in columns or df.columns if c.lower() not in {k.lower() for k in keys}]
    lows = bounds(df, keys, ranges)
    spark, kinds = df.sparkSession, df.select(*keyed(df, keys)).schema
    spark.createDataFrame([tuple(r) for r in lows], kinds).coalesce(1).write.parquet(f"{path}/bounds")
    digests(df, keys, lows, columns).coalesce(1).write.parquet(f"{path}/digests")


def load(spark: SparkSession, path: str, keys: Sequence[str]) -> tuple[list[Row], DataFrame]:
    return spark.read.parquet(f"{path}/bounds").select(*map(column, keys)).orderBy(*map(column, keys)).collect(), spark.read.parquet(f"{path}/digests")


def differing(mine: DataFrame, theirs: DataFrame, size: int) -> list[int]:
    """The ranges whose digests differ, from the top down: of each level only the groups below a group that differs are compared."""
    kept = [{(r.level, r.id): (r.n, r.a, r.b) for r in side.collect()} for side in (mine, theirs)]  # some rows more than ranges
    open_ = [0]
    for level in range(_height(size), -1, -1):
        open_ = [k for k in open_ if kept[0].get((level, k)) != kept[1].get((level, k))]
        if level:
            open_ = [child for k in open_ for child in range(k * FAN, min((k + 1) * FAN, math.ceil(size / FAN ** (level - 1))))]
    return open_


def within_ranges(df: DataFrame, keys: Sequence[str], lows: Sequence[Row], ids: Sequence[int]) -> DataFrame:
    """The rows of some ranges. Bounds of the first key of each run of neighbours reach the scan's filter."""
    spans: list[list[int]] = []
    for k in ids:
        if spans and spans[-1][1] == k - 1:
            spans[-1][1] = k
        else:
            spans.append([k, k])
    first_key = named(df, keys[0])
    head = column(first_key.name)
    near = head.isNull()
    for first, last in spans:
        low = head >= literal(lows[first - 1][0], first_key.dataType) if first else None
        high = head <= literal(lows[last][0], first_key.dataType) if last < len(lows) else None
        near = near | (low & high if low is not None and high is not None else low if low is not None else high if high is not None else F.lit(True))
    return df.where(near).where(range_of(df, keys, lows).isin(list(ids))) if ids else df.limit(0)


def range_diff(source: DataFrame, target: DataFrame, keys: Sequence[str], saved: str | None = None, ranges: int = RANGES, columns: Sequence[str] | None = None) -> DataFrame:
    """The same rows as row_diff; with the path of the target's saved digests, the target is only read where it differs. A source whose keys have other
    types is read whole where ranges differ. As everywhere, keys aren't null."""
    low = {k.lower() for k in keys}
    columns = [c for c in columns or shared_columns(source, target) if c.lower() not in low]
    if saved:
        lows, theirs = load(source.sparkSession, saved, keys)
    else:
        lows = bounds(target, keys, ranges)
        theirs = digests(target, keys, lows, columns)
    ids = differing(digests(source, keys, lows, columns, target), theirs, len(lows) + 1)
    if all(named(source, k).dataType == named(target, k).dataType for k in keys):
        mine = within_ranges(source, keys, lows, ids)
    else:
        mine = source.where(range_of(source, keys, lows, target).isin(list(ids)))
    return row_diff(mine, within_ranges(target, keys, lows, ids), keys, columns)
