"""Saved runs: what a comparison or sync found, for later pages and history without comparing again, and copies that go on where they stopped.

A store is a folder of Parquet: `runs` has a row a run, `reports` a row a table of a run, `differences` the keys that differ of a table of a run, ranked within their
class and written in that order, so that a page of them reads the row groups that hold it.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import column, literal, named
from ..operators import digests
from ..operators.diff import ranges_of, row_diff, side_by_side
from ..operators.project import within
from .report import run_status

RUNS = "run_id string, kind string, profile string, status string, started timestamp_ntz, finished timestamp_ntz, tables long, failed long, rows long"


def ranked(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Differences with their place in their class by key, from 1. Ranges of the key are counted, and ranked each by itself."""
    ranged = ranges_of(found, keys)
    counts = {(r._part, r.change_type): r.n for r in ranged.groupBy("_part", "change_type").agg(F.count(F.lit(1)).alias("n")).collect()}  # three rows a range
    so_far: dict[str, int] = {}
    before = []
    for (part, kind), n in sorted(counts.items()):
        before.append((part, kind, so_far.get(kind, 0)))
        so_far[kind] = so_far.get(kind, 0) + n
    offsets = found.sparkSession.createDataFrame(before, "_part int, change_type string, _before long")
    order = W.partitionBy("_part", "change_type").orderBy(*map(column, keys))
    placed = ranged.join(F.broadcast(offsets), ["_part", "change_type"])
    return placed.select("change_type", (F.col("_before") + F.row_number().over(order)).alias("place"), *map(column, keys))


def save_run(spark: SparkSession, store: str, kind: str, report: DataFrame, started: datetime.datetime, profile: str | None = None, differences: Mapping[str, tuple[DataFrame, Sequence[str]]] | None = None) -> str:
    """Saves a run: its report (as sync_tables or compare_tables give it) and, by table, the differences and their keys. The run's id.

    The row in `runs` is written last: a run that isn't whole has none, and nobody finds it."""
    run_id = uuid.uuid4().hex
    for name, (found, keys) in (differences or {}).items():
        rows = ranked(found, keys).repartitionByRange("change_type", "place").sortWithinPartitions("change_type", "place")
        rows.write.parquet(f"{store}/differences/{run_id}/{name}")
    counted = "rows" if "rows" in report.columns else "target_rows"
    rows = report.withColumn("rows", F.col(counted)).select("table", "inserted", "updated", "deleted", "rows", "error")
    rows.coalesce(1).write.parquet(f"{store}/reports/{run_id}")
    s = run_status(spark.read.parquet(f"{store}/reports/{run_id}")).first()
    one = (run_id, kind, profile, s.status, started, datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None), s.tables, s.failed, int(s.rows))
    spark.createDataFrame([one], RUNS).coalesce(1).write.mode("append").parquet(f"{store}/runs")
    return run_id


def runs(spark: SparkSession, store: str) -> DataFrame:
    """A row for each saved run, for run_history."""
    try:
        return spark.read.schema(RUNS).parquet(f"{store}/runs")
    except AnalysisException:
        return spark.createDataFrame([], RUNS)


def report_of(spark: SparkSession, store: str, run_id: str) -> DataFrame:
    return spark.read.parquet(f"{store}/reports/{run_id}")


def saved_page(spark: SparkSession, store: str, run_id: str, table: str, source: DataFrame, target: DataFrame, keys: Sequence[str], change_type: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page (200 rows at most, else ValueError) of the saved differences of a class, with both sides' values as they are now. Nothing is compared again."""
    places = F.col("place").between(offset + 1, offset + within(limit, 200))
    found = spark.read.parquet(f"{store}/differences/{run_id}/{table}").where((F.col("change_type") == change_type) & places)
    # both sides are asked for the page's keys only
    asked = [tuple(r) for r in found.select(*map(column, keys)).collect()]  # limit rows at most
    kind = named(found, keys[0]).dataType
    return side_by_side(found, *[side.where(_near(named(side, keys[0]), kind, asked)) for side in (source, target)], keys)


def _near(field: T.StructField, kind: T.DataType, asked: Sequence[tuple]) -> Column:
    """Bounds of the first key, which reach the scan. A side whose key has another type has another order, and is read whole."""
    heads = sorted((a[0] for a in asked if a[0] is not None), key=lambda x: (x != x, x))  # NaN comes last
    if heads and field.dataType != kind and not all(isinstance(k, T.IntegralType) for k in (field.dataType, kind)):
        return F.lit(True)
    return column(field.name).between(literal(heads[0], kind), literal(heads[-1], kind)) if heads else F.lit(False)


# Work by key ranges, with a ledger ------------------------------------------------------------------------------------------


def by_ranges(path: str, source: DataFrame, keys: Sequence[str], make: Callable[[list[Row], int], DataFrame], ranges: int = 64, most: int | None = None) -> int:
    """Does a job range by range of the source's key, each into a folder of its own, and goes on where it stopped: the number of ranges still open.

    The bounds are written first and stay; a range is finished when Spark's mark of success is in its folder, and is written anew as a whole if not. make gives the rows of a
    range. most: ranges to do now (all if None)."""
    spark = source.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    done = lambda name: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS"))
    kinds = T.StructType([T.StructField(k, named(source, k).dataType) for k in keys])
    if not done("bounds"):
        lows = digests.bounds(source, keys, ranges)
        spark.createDataFrame([tuple(r) for r in lows], kinds).coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")
    lows = spark.read.schema(kinds).parquet(f"{path}/bounds").orderBy(*map(column, keys)).collect()
    left = [k for k in range(len(lows) + 1) if not done(f"rows/range={k}")]
    for k in left[:most]:
        make(lows, k).write.mode("overwrite").parquet(f"{path}/rows/range={k}")
    return max(0, len(left) - (len(left) if most is None else most))


def resumable_copy(source: DataFrame, path: str, keys: Sequence[str], ranges: int = 64, most: int | None = None) -> int:
    """Copies a table by key ranges; a copy that was stopped goes on and reads no finished range. The number of ranges still open."""
    return by_ranges(path, source, keys, lambda lows, k: digests.within_ranges(source, keys, lows, [k]), ranges, most)


def resumable_diff(source: DataFrame, target: DataFrame, keys: Sequence[str], path: str, ranges: int = 64, most: int | None = None) -> int:
    """Compares two tables by ranges of the target's key, in the same way."""
    pick = lambda df, lows, k: digests.within_ranges(df, keys, lows, [k])
    return by_ranges(path, target, keys, lambda lows, k: row_diff(pick(source, lows, k), pick(target, lows, k), keys), ranges, most)


def finished(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the finished ranges."""
    # each folder by itself: the ranges' numbers don't become a column, whose name the table may have
    return spark.read.parquet(f"{path}/rows/range=*")
