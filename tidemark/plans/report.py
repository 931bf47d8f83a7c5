"""Many tables at once: inventories, comparisons, syncs, their reports and history."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import publish, snapshot, staged_beside
from ..operators import apply, diff, verify
from ..operators.mask import MaskRule, masked
from ..operators.project import mapped, where_fragment, within

REPORT = "`table` string, method string, inserted long, updated long, deleted long, rows long, verified boolean, error string"
COMPARISON = "`table` string, source_rows long, target_rows long, inserted long, updated long, deleted long, structure_changes long, error string"


@dataclass(frozen=True)
class TableSelection:
    """What is synchronised of one table, and how."""

    keys: Sequence[str] = ()
    method: str = "row_diff"  #: row_diff, full_copy
    where: str | None = None
    renames: Mapping[str, str] = field(default_factory=dict)
    exclude: Sequence[str] = ()
    masks: Sequence[MaskRule] = ()
    delete_extra: bool = False
    conflict: str = "error"
    verify: str = "count"  #: none, count, sample, full


def inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """A row for each table with its number of rows; Parquet answers counts from its footers."""
    each = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()]
    return functools.reduce(DataFrame.unionByName, each)


def prepared(source: DataFrame, target: DataFrame, s: TableSelection) -> DataFrame:
    rows = where_fragment(source, s.where)
    if s.masks:
        rows = masked(rows, s.keys, s.masks)
    return mapped(rows, target.columns, s.renames, s.exclude)


def structure_changes(source: DataFrame, target: DataFrame) -> int:
    a, b = ({f.name.lower(): f.dataType for f in df.schema.fields} for df in (source, target))
    return sum(a.get(c) != b.get(c) for c in {*a, *b})


def compare_tables(spark: SparkSession, sources: Mapping[str, DataFrame], targets: Mapping[str, DataFrame], selections: Mapping[str, TableSelection]) -> DataFrame:
    """A row of counters for each selected table; one without a target or a key has an error. One lazy plan for all of them."""
    out = []
    for name, s in selections.items():
        source, target = sources[name], targets.get(name)
        head = lambda df, t, error: df.select(F.lit(name).alias("table"), "source_rows", "target_rows", "inserted", "updated", "deleted", F.lit(t).cast("long").alias("structure_changes"), F.lit(error).cast("string").alias("error"))  # noqa: E731, B023
        if target is None:
            n = source.agg(F.count(F.lit(1)).alias("inserted")).select("inserted", F.col("inserted").alias("source_rows"), *[F.lit(0).cast("long").alias(c) for c in ("target_rows", "updated", "deleted")])
            out.append(head(n, 1, "the target has no such table"))
        elif not s.keys:
            n = verify.counts(source, target, s.where).select("source_rows", "target_rows", *[F.lit(0).cast("long").alias(c) for c in ("inserted", "updated", "deleted")])
            out.append(head(n, structure_changes(source, target), "the table has no key; compare it as a multiset"))
        else:
            n = diff.summary(prepared(source, target, s), target, s.keys)
            n = n.withColumn("source_rows", F.col("inserted") + F.col("updated") + F.col("same")).withColumn("target_rows", F.col("deleted") + F.col("updated") + F.col("same"))
            out.append(head(n, structure_changes(source, target), None))
    return functools.reduce(DataFrame.unionByName, out)


def sync_table(source: DataFrame, target: DataFrame, s: TableSelection) -> DataFrame:
    """The target's new content."""
    return synced(prepared(source, target, s), target, s)


def synced(rows: DataFrame, target: DataFrame, s: TableSelection) -> DataFrame:
    if s.method == "row_diff" and s.keys:
        return apply.merged(rows, target, s.keys, s.delete_extra)
    return apply.copied(rows, target, s.keys, s.conflict)


def sync_tables(
    spark: SparkSession, sources: Mapping[str, DataFrame], targets: Mapping[str, DataFrame], selections: Mapping[str, TableSelection],
    paths: Mapping[str, str] | None = None, parallel: int = 2,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """New content of each table, and a report row for each; a table that fails doesn't stop the others.

    Up to `parallel` tables (1 to 8) run at a time, each with its job group in the scheduler pool `sync`. A table's prepared source is written once, to
    the shared folder; its new content once as well, beside its path if it has one, and everything in the report is read from there. Only after a passed check
    does the new content take the place of the Parquet table at that path; otherwise the report says why, and the path stays as it was.
    """
    context = spark.sparkContext

    def one(name: str) -> tuple[DataFrame | None, tuple]:
        s = selections[name]
        method = s.method if s.keys or s.method == "full_copy" else "full_copy"
        context.setJobGroup(f"sync-{name}", f"sync of {name}")
        context.setLocalProperty("spark.scheduler.pool", "sync")
        try:
            source, target = sources[name], targets[name]
            mine = snapshot(prepared(source, target, s))
            if s.keys and not diff.duplicate_keys(mine, s.keys).isEmpty():
                raise apply.KeyConflict("two source rows have the same key")
            path, new = (paths or {}).get(name), synced(mine, target, s)
            staged = staged_beside(new, path) if path else None
            new = spark.read.schema(new.schema).parquet(staged) if path else snapshot(new)
            n = diff.summary(mine, target, s.keys).first() if s.keys else None
            total = new.count()
            ok = None
            if s.verify != "none":
                if s.verify in ("full", "sample") and s.keys:
                    ok = (verify.full if s.verify == "full" else verify.sample)(mine, new, s.keys).first().passed
                else:
                    ok = total == mine.count()
            counted = n.inserted if n else total, n.updated if n else 0, n.deleted if n else 0, total
            if path and ok is False:
                return None, (name, method, *counted, ok, f"the check failed; {path} is as it was, the new content in {staged}")
            if path:
                publish(spark, staged, path)
                new = spark.read.parquet(path)
            return new, (name, method, *counted, ok, None)
        except (PySparkException, Py4JJavaError, OSError, ValueError, KeyError) as e:
            return None, (name, method, 0, 0, 0, 0, None, str(e)[:500])
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, min(8, parallel))) as pool:
        found = dict(zip(selections, pool.map(one, selections)))
    done = {name: new for name, (new, _) in found.items() if new is not None}
    return done, spark.createDataFrame([row for _, row in found.values()], REPORT)


def run_status(report: DataFrame) -> DataFrame:
    """One row: tables, failed, rows, status."""
    totals = report.agg(F.count(F.lit(1)).alias("tables"), F.count("error").alias("failed"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    status = F.when(F.col("failed") == 0, "Completed").when(F.col("failed") < F.col("tables"), "PartiallyFailed").otherwise("Failed")
    return totals.withColumn("status", status)


def run_history(runs: DataFrame, kind: str | None = None, status: str | None = None, profile: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page (200 rows at most, else ValueError) of saved runs, newest first."""
    for c, v in (("kind", kind), ("status", status), ("profile", profile)):
        if v is not None:
            runs = runs.where(F.col(c) == v)
    return runs.orderBy(F.col("started").desc(), F.col("run_id").desc()).offset(max(0, offset)).limit(within(limit, 200))
