"""Checks after a copy or sync."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import diff
from .project import key_range, keyset_page, where_fragment


def counts(source: DataFrame, target: DataFrame, where: str | None = None) -> DataFrame:
    """One row: rows of the (filtered) source, rows of the whole target, and whether they are equal."""
    n = lambda df, s, t: df.select(F.lit(s).alias("s"), F.lit(t).alias("t"))
    both = n(where_fragment(source, where), 1, 0).unionAll(n(target, 0, 1))
    return both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("source_rows"), F.coalesce(F.sum("t"), F.lit(0)).alias("target_rows")).withColumn("equal", F.col("source_rows") == F.col("target_rows"))


def sample(source: DataFrame, target: DataFrame, keys: Sequence[str], size: int = 2000) -> DataFrame:
    """Counters of the first key window only; later differences pass."""
    head = keyset_page(source, keys, None, size)
    top = head.orderBy(*[F.col(k).desc() for k in keys]).select(*keys).first()
    window = key_range(target, keys, None, tuple(top)) if top else target
    return passed(diff.summary(head, window, keys))


def full(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counters of the whole comparison and whether there is no difference."""
    return passed(diff.summary(source, target, keys))


def passed(summary: DataFrame) -> DataFrame:
    return summary.withColumn("passed", F.col("inserted") + F.col("updated") + F.col("deleted") == 0)
