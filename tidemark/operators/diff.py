"""Comparison of two tables by key and a 128-bit hash of the values.

The full outer join carries keys and hashes only; whole rows are fetched for the keys that differ. Source values are cast to the
target's types before hashing; one that can't be cast differs from everything. Keys must be unique and not null; duplicate_keys finds what isn't. A source key
that can't be cast to the target's type meets no key there: its row is an insert, with a null key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bitmaps import bits_for, mark_survivors, survivor_bitmap
from ..functions.canonical import as_types, cell, coerced, column, fresh, key_text, named, one_zero, plain_text, value_hash
from ..functions.staging import snapshot
from .project import after_key, within

INSERT, UPDATE, DELETE, SAME = "insert", "update", "delete", "same"


def shared_columns(source: DataFrame, target: DataFrame) -> list[str]:
    low = {c.lower() for c in source.columns}
    return [c for c in target.columns if c.lower() in low]


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*map(column, keys)).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def keyed(df: DataFrame, keys: Sequence[str], like: DataFrame | None = None) -> list[Column]:
    """The key columns, named as asked for and, with `like`, of that table's types."""
    fields = [named(df, k) for k in keys]
    typed = [coerced(column(f.name), f.dataType, named(like, k).dataType) if like is not None else column(f.name) for f, k in zip(fields, keys)]
    return [c.alias(k) for c, k in zip(typed, keys)]


def hashed(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, like: DataFrame | None = None) -> DataFrame:
    return df.select(*keyed(df, keys, like), value_hash(df, columns, like.schema if like is not None else None).alias(name))


def classified(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """keys and change_type of every key of either side."""
    columns = columns or shared_columns(source, target)
    both = hashed(source, keys, columns, "_hs", target).join(hashed(target, keys, columns, "_ht"), list(keys), "full_outer")
    kind = F.when(F.col("_ht").isNull(), INSERT).when(F.col("_hs").isNull(), DELETE).when(F.col("_hs") != F.col("_ht"), UPDATE).otherwise(SAME)
    return both.select(*map(column, keys), kind.alias("change_type"))


def row_diff(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    return classified(source, target, keys, columns).where(F.col("change_type") != SAME)


def inserted(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    return source.join(target.select(*keyed(target, keys)), list(keys), "left_anti")


def deleted(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.join(source.select(*keyed(source, keys)), list(keys), "left_anti")


def updated(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Source rows, in the target's types, whose key is in the target with other values."""
    return as_types(source, target.schema).join(updated_keys(source, target, keys, columns), list(keys), "left_semi")


def updated_keys(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The keys of both sides whose values differ, written once: whole rows are then fetched by a list whose size Spark knows."""
    columns = columns or shared_columns(source, target)
    both = hashed(source, keys, columns, "_hs", target).join(hashed(target, keys, columns, "_ht"), list(keys))
    # null-safe, so that no filter for nulls computes the hashes a second time
    return snapshot(both.where(~F.col("_hs").eqNullSafe(F.col("_ht"))).select(*map(column, keys)))


def summary(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One row: inserted, updated, deleted, same."""
    kinds = classified(source, target, keys, columns)
    return kinds.agg(*[F.count_if(F.col("change_type") == k).alias(n) for k, n in ((INSERT, "inserted"), (UPDATE, "updated"), (DELETE, "deleted"), (SAME, "same"))])


def multiset_diff(source: DataFrame, target: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Tables without a key: rows as a multiset of hashes; how many each side has more than the other, with one row of the hash.

    Only hashes are counted and compared; whole rows are fetched for the hashes that differ: a bitmap of these, of 16 MB at most, leaves the others
    out of the scan, so that they aren't shuffled.
    """
    columns = columns or shared_columns(source, target)
    like = target.schema
    one = lambda df, n: df.select(value_hash(df, columns, like).alias("h"), F.lit(n).alias("_n")).select("h.a", "h.b", "_n")
    counts = one(source, 1).unionAll(one(target, -1)).groupBy("a", "b").agg(F.sum("_n").alias("more"))
    differs = snapshot(counts.where("more <> 0"))
    typed = lambda df, c: coerced(column(named(df, c).name), named(df, c).dataType, named(target, c).dataType)

    def rows(df: DataFrame, wanted: DataFrame) -> DataFrame:
        whole = df.select(value_hash(df, columns, like).alias("h"), F.struct(*[typed(df, c).alias(c) for c in columns]).alias("row")).select("h.a", "h.b", "row")
        bits = bits_for(wanted.count())
        near = mark_survivors(whole, "a", survivor_bitmap(wanted, "a", bits), "_may", bits).where("_may").drop("_may")
        return near.join(wanted, ["a", "b"]).groupBy("a", "b").agg(F.first("row").alias("row"), F.first("more").alias("more"))

    # what the source has more of is fetched from the source, the rest from the target
    found = rows(source, differs.where("more > 0")).unionAll(rows(target, differs.where("more < 0")))
    zero = F.lit(0).cast("long")
    return found.select("row.*", F.greatest("more", zero).alias("only_source"), F.greatest(-F.col("more"), zero).alias("only_target"))


def windows(source: DataFrame, target: DataFrame, keys: Sequence[str], size: int, columns: Sequence[str] | None = None) -> DataFrame:
    """Each difference and each source key with its window: `size` source keys in key order make one; target rows beyond the last
    source key are the tail, in windows of their own.

    The number of source keys before a row is a prefix count: rows are dealt out by key ranges, counted in each, and only one number
    a range goes through the driver.
    """
    kinds = classified(source, target, keys, columns)
    ranged = ranges_of(kinds, keys)
    mine = (F.col("change_type") != DELETE).cast("long")
    before, rest, total = {}, {}, 0
    counts = {r._part: (r.n, r.m) for r in ranged.groupBy("_part").agg(F.sum(mine).alias("n"), F.sum(1 - mine).alias("m")).collect()}
    gone = 0
    for part in sorted(counts):
        before[part], rest[part] = total, gone
        total, gone = total + counts[part][0], gone + counts[part][1]
    spark = source.sparkSession
    offsets = spark.createDataFrame([(p, before[p], rest[p]) for p in before], "_part int, _before long, _gone long")
    in_part = W.partitionBy("_part").orderBy(*map(column, keys)).rowsBetween(W.unboundedPreceding, -1)
    placed = ranged.withColumn("_n", F.coalesce(F.sum(mine).over(in_part), F.lit(0))).withColumn("_d", F.coalesce(F.sum(1 - mine).over(in_part), F.lit(0)))
    placed = placed.join(F.broadcast(offsets), "_part").withColumn("_at", F.col("_before") + F.col("_n")).withColumn("_del", F.col("_gone") + F.col("_d"))
    tail = (F.col("change_type") == DELETE) & (F.col("_at") == total)
    first_tail = placed.where(tail).agg(F.min("_del")).first()[0] or 0
    whole = -(-total // size)
    chunk = F.when(tail, whole + F.floor((F.col("_del") - first_tail) / size)).otherwise(F.least(F.floor(F.col("_at") / size), F.lit(max(whole - 1, 0))))
    return placed.select(*map(column, keys), "change_type", chunk.cast("long").alias("chunk"), tail.alias("is_tail"))


def window_counts(placed: DataFrame) -> DataFrame:
    """One row: windows, and windows with a difference."""
    by = placed.groupBy("chunk").agg(F.max((F.col("change_type") != SAME).cast("int")).alias("differs"))
    return by.agg(F.count(F.lit(1)).alias("windows"), F.coalesce(F.sum("differs"), F.lit(0)).alias("diff_windows"))


def diff_keys(source: DataFrame, target: DataFrame, keys: Sequence[str], cap: int = 2000) -> DataFrame:
    """The first `cap` keys of each class with a flag that says whether there are more.

    Ranks are counted by ranges of the key: rows are dealt out by ranges, a range's classes are counted, and only ranges that begin before the cap
    are ranked, each in its own task.
    """
    ranged = ranges_of(row_diff(source, target, keys), keys)
    counts = {(r._part, r.change_type): r.n for r in ranged.groupBy("_part", "change_type").agg(F.count(F.lit(1)).alias("n")).collect()}  # three rows a range
    totals: dict[str, int] = {}
    open_ = []
    for (part, kind), n in sorted(counts.items()):
        if (before := totals.get(kind, 0)) < cap:
            open_.append((part, kind, before))
        totals[kind] = before + n
    offsets = source.sparkSession.createDataFrame([(*o, totals[o[1]] > cap) for o in open_], "_part int, change_type string, _before long, truncated boolean")
    order = W.partitionBy("_part", "change_type").orderBy(*map(column, keys))
    placed = ranged.join(F.broadcast(offsets), ["_part", "change_type"]).withColumn("position", (F.col("_before") + F.row_number().over(order)).cast("int"))
    return placed.where(F.col("position") <= cap).select("change_type", "position", key_text(placed, keys).alias("pk_key"), "truncated")


def ranges_of(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """found dealt out by ranges of its key, with the number of the range as _part. Ranges are sampled, so they are written once."""
    return snapshot(found.repartitionByRange(*map(column, keys)).withColumn("_part", F.spark_partition_id()))


def side_by_side(found: DataFrame, source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Differences with both sides' values as source_… and target_…"""
    low = {k.lower() for k in keys}
    side = lambda df, name: df.select(*keyed(df, keys, target), *[column(c).alias(f"{name}_{c}") for c in df.columns if c.lower() not in low])
    return found.join(side(source, "source"), list(keys), "left").join(side(target, "target"), list(keys), "left")


def samples(source: DataFrame, target: DataFrame, keys: Sequence[str], size: int, limit: int = 20) -> DataFrame:
    """The first differences: by window, in a window by source key, then target-only rows; never from the tail."""
    found = windows(source, target, keys, size).where((F.col("change_type") != SAME) & ~F.col("is_tail"))
    first = found.orderBy("chunk", (F.col("change_type") == DELETE).cast("int"), *map(column, keys)).limit(limit)
    return side_by_side(first.drop("is_tail"), source, target, keys)


def diff_page(source: DataFrame, target: DataFrame, keys: Sequence[str], change_type: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page (200 rows at most, else ValueError) of the differences of one class with both sides' values."""
    found = row_diff(source, target, keys).where(F.col("change_type") == change_type).orderBy(*map(column, keys)).offset(offset).limit(within(limit, 200))
    return side_by_side(found, source, target, keys)


def changed_cells(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """keys, column, old (target) and new (source) text of each changed cell of updated rows; text that can't be cast to the target's type is a change.
    Keys and hashes find the rows that differ; only those are fetched whole."""
    low = {k.lower() for k in keys}
    columns = [c for c in columns or shared_columns(source, target) if c.lower() not in low]
    differs = updated_keys(source, target, keys, columns)
    mark = fresh(source, target)
    side = lambda df, p: df.select(*keyed(df, keys, target), *[column(named(df, c).name).alias(f"{mark}{p}{i}") for i, c in enumerate(columns)]).join(differs, list(keys), "left_semi")
    both = side(source, "s").join(side(target, "t"), list(keys))
    each = []
    for i, c in enumerate(columns):
        field, have = named(target, c), named(source, c).dataType
        role = (field.metadata or {}).get("role", "")
        new, old = column(f"{mark}s{i}"), column(f"{mark}t{i}")
        typed = coerced(new, have, field.dataType)
        lost = new.isNotNull() & typed.isNull()
        changed = lost | (cell(one_zero(typed, field.dataType), field.dataType, role) != cell(one_zero(old, field.dataType), field.dataType, role))
        shown = F.when(lost, plain_text(new, have)).otherwise(plain_text(typed, field.dataType))
        each.append(F.when(changed, F.struct(F.lit(c).alias("column"), plain_text(old, field.dataType).alias("old_value"), shown.alias("new_value"))))
    cells = both.select(*map(column, keys), F.explode(F.array_compact(F.array(*each))).alias(f"{mark}c"))
    return cells.select(*map(column, keys), f"{mark}c.*")


def resumed(df: DataFrame, keys: Sequence[str], after: Sequence) -> DataFrame:
    return df.where(after_key(keys, after))


def extra_tables(selected: DataFrame, present: DataFrame, name: str = "table") -> DataFrame:
    """Tables that are present but not selected, whatever the case of their names."""
    low: Column = F.lower(F.col(name))
    return present.withColumn("_low", low).join(selected.select(low.alias("_low")).distinct(), "_low", "left_anti").drop("_low")
