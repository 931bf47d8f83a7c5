"""Copy, merge and change sets. Each function returns the table's new content as one plan; writing it is the caller's last step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import as_types, coerced, column, fresh, named, value_hash
from ..functions.staging import remove_partitions, snapshot
from .diff import duplicate_keys, keyed
from .project import after_key, column_pairs

MODES = ("error", "truncate", "skip_existing")


class KeyConflict(ValueError):
    """A copy in mode `error` met a key that the target has."""


def shaped(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source rows with the target's columns in its order: matched by name, cast, null where the source has none."""
    by = {c.lower(): c for c in source.columns}
    out = []
    for f in target.schema.fields:
        have = by.get(f.name.lower())
        value = coerced(F.col(f"`{have}`"), source.schema[have].dataType, f.dataType) if have else F.lit(None).cast(f.dataType)
        out.append(value.alias(f.name))
    return source.select(*out)


def copied(source: DataFrame, target: DataFrame, keys: Sequence[str] = (), mode: str = "error") -> DataFrame:
    """The target after a full copy. Without a key, skip_existing works as error does, and error can't see conflicts."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    rows = shaped(source, target)
    if mode == "truncate":
        return rows
    if mode == "skip_existing" and keys:
        return target.unionByName(rows.join(target.select(*keyed(target, keys)), list(keys), "left_anti"))
    if keys and not rows.join(target.select(*keyed(target, keys)), list(keys), "left_semi").isEmpty():
        raise KeyConflict("the target has rows with keys of the source")
    return target.unionByName(rows)


def resumed_copy(source: DataFrame, target: DataFrame, keys: Sequence[str], after: Sequence) -> DataFrame:
    """The target with the source rows beyond a key appended."""
    return target.unionByName(shaped(source.where(after_key(keys, after)), target))


def merged(source: DataFrame, target: DataFrame, keys: Sequence[str], delete_extra: bool = False) -> DataFrame:
    """The target after source rows are inserted or update what they match; target-only rows go if delete_extra.

    Only columns that the source has change; the others keep their values, and are null in new rows. One join, no second pass.
    """
    keys = [named(target, k).name for k in keys]
    pairs = {t: s for s, t in column_pairs(source, target.columns)[0]}
    typed = as_types(source.select(*[column(s).alias(t) for t, s in pairs.items()]), target.schema)
    mark = fresh(target)
    s = typed.select(*map(column, keys), F.lit(True).alias(f"{mark}in"), *[column(c).alias(f"{mark}{c}") for c in typed.columns if c not in keys])
    both = s.join(target, list(keys), "left" if delete_extra else "full_outer")
    value = lambda c: F.when(column(f"{mark}in"), column(f"{mark}{c}")).otherwise(column(c)).alias(c)
    return both.select(*[column(c) if c in keys or c not in typed.columns else value(c) for c in target.columns])


def change_set(target: DataFrame, keys: Sequence[str], inserts: DataFrame | None = None, updates: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """The target after inserts, partial updates and deletes by key, as one unit.

    updates has the keys, new values and `_set`, the names of the columns that a row changes. ValueError for changes by key without a key;
    KeyConflict if two updates have one key, since neither could be told to be the last.
    """
    if updates is not None and keys and not duplicate_keys(updates, keys).isEmpty():
        raise KeyConflict("two updates have the same key")
    if not keys and (updates is not None or deletes is not None):
        raise ValueError("updates and deletes need a key")
    out = target.unionByName(shaped(inserts, target)) if inserts is not None else target
    if updates is not None:
        mark = fresh(target)
        new = updates.select(*map(column, keys), F.col("_set").alias(f"{mark}set"), *[column(c).alias(f"{mark}n{c}") for c in updates.columns if c not in (*keys, "_set")])
        out = out.join(new, list(keys), "left")
        value = lambda c: F.when(F.array_contains(f"{mark}set", c), column(f"{mark}n{c}")).otherwise(column(c)).alias(c)
        out = out.select(*[value(c) if f"{mark}n{c}" in out.columns else column(c) for c in target.columns])
    if deletes is not None:
        out = out.join(deletes.select(*map(column, keys)), list(keys), "left_anti")
    return out


def change_set_counts(target: DataFrame, keys: Sequence[str], inserts: DataFrame, updates: DataFrame, deletes: DataFrame) -> DataFrame:
    """One row: rows inserted, and rows that updates and deletes meet (after the inserts)."""
    there = target.select(*keys).unionByName(inserts.select(*keys))
    n = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    met = lambda df: there.join(df.select(*keys).distinct(), list(keys), "left_semi")
    rows = n(inserts, "inserted").unionByName(n(met(updates), "updated")).unionByName(n(met(deletes), "deleted"))
    return rows.agg(*[F.coalesce(F.max(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("inserted", "updated", "deleted")])


def merge_into_path(source: DataFrame, path: str, keys: Sequence[str], partitions: Sequence[str], delete_extra: bool = False) -> DataFrame:
    """Merges source into a Parquet table that is partitioned by `partitions`, and rewrites only the partitions that change.

    The comparison moves keys, partition values and 16 bytes a row; whole rows are read for partitions with an inserted, updated or (with
    delete_extra) deleted row only. A row whose update moves it changes both its partitions. New files are complete before old ones go, partition by
    partition, so a run that dies in between leaves some partitions new and some old, and can be run again; `stored` has tables that switch at once.
    Partition values keep the source's types (01 stays 01). KeyConflict if two source rows have one key. Returns a row for each partition that
    changed: its values, inserted, updated, deleted.
    """
    spark = source.sparkSession
    names, both = list(partitions), list(keys)
    # Spark would guess the types of partition values from folder names
    own = {p: T.StructField(p, named(source, p).dataType) for p in names}
    target = spark.read.schema(T.StructType([own.get(f.name, f) for f in spark.read.parquet(path).schema.fields])).parquet(path)
    rows = shaped(source, target)
    if not duplicate_keys(rows, both).isEmpty():
        raise KeyConflict("two source rows have the same key")
    mine = rows.select(*both, F.struct(*names).alias("_ps"), value_hash(rows, target.columns).alias("_hs"))
    there = target.select(*both, F.struct(*names).alias("_pt"), value_hash(target, target.columns).alias("_ht"))
    kind = F.when(F.col("_ht").isNull(), "inserted").when(F.col("_hs").isNull(), "deleted").otherwise("updated")
    joined = mine.join(there, both, "full_outer").where(~F.col("_hs").eqNullSafe(F.col("_ht")))
    found = joined.select(*both, "_ps", "_pt", kind.alias("kind"))
    found = snapshot(found if delete_extra else found.where("kind <> 'deleted'"))
    sides = found.select("kind", F.explode(F.array_distinct(F.array_compact(F.array("_ps", "_pt")))).alias("_p"))
    changed = snapshot(sides.groupBy("_p").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("inserted", "updated", "deleted")]).select("_p.*", "inserted", "updated", "deleted"))
    same = lambda df: [df[c].eqNullSafe(changed[c]) for c in names]
    old = target.join(changed, same(target), "left_semi")
    wanted = old.select(*both).unionByName(found.select(*both)).distinct()
    new = merged(rows.join(wanted, both, "left_semi"), old, both, delete_extra)
    staged = snapshot(new)
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*names).parquet(path)
    empty = changed.join(staged, same(staged), "left_anti")
    remove_partitions(spark, path, empty.select(*names))
    return changed


def truncated(table: DataFrame) -> DataFrame:
    """No rows, same schema."""
    return table.limit(0)
