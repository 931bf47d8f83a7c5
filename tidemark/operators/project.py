"""Filters, projections, ordering and paging of one table."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import column, named


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: Any = None


def comparison(df: DataFrame, f: Filter) -> Column:
    """A structured filter as a column, named in any case; its value is cast to the column's type. ValueError for an unknown column or operator."""
    field = named(df, f.column)
    c, kind = column(field.name), field.dataType
    value = lambda v: F.lit(v).try_cast(kind)
    match f.op.lower():
        case "=":
            return c == value(f.value)
        case "!=" | "<>":
            return c != value(f.value)
        case ">":
            return c > value(f.value)
        case "<":
            return c < value(f.value)
        case ">=":
            return c >= value(f.value)
        case "<=":
            return c <= value(f.value)
        case "like" | "not_like":
            text, part = c.cast("string"), str(f.value)
            hit = text.like(f"%{part}%") if "%" in part or "_" in part else text.contains(part)
            return hit if f.op.lower() == "like" else ~hit
        case "is_null":
            return c.isNull()
        case "is_not_null":
            return c.isNotNull()
        case "in" | "not_in":
            if not f.value:
                return F.lit(False)
            hit = c.isin([value(v) for v in f.value])
            return hit if f.op.lower() == "in" else ~hit | c.isNull()
    raise ValueError(f"unknown operator: {f.op}")


def filtered(df: DataFrame, filters: Iterable[Filter]) -> DataFrame:
    """Rows that meet all filters; all are checked before any is applied."""
    found = [comparison(df, f) for f in filters]
    return df.where(functools.reduce(Column.__and__, found)) if found else df


def where_fragment(df: DataFrame, fragment: str | None) -> DataFrame:
    """Rows that meet a free condition. ValueError if it holds a statement end or comment, or doesn't compile."""
    if not fragment or not fragment.strip():
        return df
    if re.search(r";|--|/\*", fragment):
        raise ValueError("a condition holds no statement end or comment")
    try:
        return df.where(fragment)
    except AnalysisException as e:
        raise ValueError(f"the condition doesn't compile: {e.getCondition()}") from e


def quick_filter(df: DataFrame, keyword: str) -> DataFrame:
    """Rows with the keyword in any column's text, whatever its case."""
    low = keyword.lower()
    return df.where(functools.reduce(Column.__or__, [F.coalesce(F.lower(F.col(f"`{c}`").cast("string")).contains(low), F.lit(False)) for c in df.columns]))


def column_pairs(source: DataFrame, target: Sequence[str], renames: Mapping[str, str] | None = None, exclude: Iterable[str] = ()) -> tuple[list[tuple[str, str]], list[str]]:
    """(source column, target column) of what is copied, and warnings about source columns that the target lacks."""
    renames, out = {k.lower(): v for k, v in (renames or {}).items()}, {c.lower() for c in exclude}
    known, pairs, warnings = {c.lower(): c for c in target}, [], []
    for c in source.columns:
        if c.lower() in out:
            continue
        name = renames.get(c.lower(), c)
        if name.lower() in known:
            pairs.append((c, known[name.lower()]))
        else:
            warnings.append(f"column {c}: the target has no column {name}; it is left out")
    return pairs, warnings


def mapped(source: DataFrame, target: Sequence[str], renames: Mapping[str, str] | None = None, exclude: Iterable[str] = ()) -> DataFrame:
    return source.select(*[F.col(f"`{s}`").alias(t) for s, t in column_pairs(source, target, renames, exclude)[0]])


def without_generated(df: DataFrame, generated: Iterable[str]) -> DataFrame:
    low = {c.lower() for c in generated}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in low])


def after_key(keys: Sequence[str], values: Sequence[Any], inclusive: bool = False) -> Column:
    """Key tuples greater than values. Written out, so that the reader can skip row groups by the first key."""
    out = None
    for k in range(len(keys)):
        last = k == len(keys) - 1
        step = column(keys[k]) >= F.lit(values[k]) if last and inclusive else column(keys[k]) > F.lit(values[k])
        for j in range(k):
            step = (column(keys[j]) == F.lit(values[j])) & step
        out = step if out is None else out | step
    return out & (column(keys[0]) >= F.lit(values[0]))


def upto_key(keys: Sequence[str], values: Sequence[Any]) -> Column:
    return ~after_key(keys, values) & (column(keys[0]) <= F.lit(values[0]))


def keyset_page(df: DataFrame, keys: Sequence[str], after: Sequence[Any] | None, limit: int, where: str | None = None) -> DataFrame:
    rows = where_fragment(df, where)
    if after is not None:
        rows = rows.where(after_key(keys, after))
    return rows.orderBy(*map(column, keys)).limit(limit)


def key_range(df: DataFrame, keys: Sequence[str], after: Sequence[Any] | None, upper: Sequence[Any] | None) -> DataFrame:
    if after is not None:
        df = df.where(after_key(keys, after))
    return df.where(upto_key(keys, upper)) if upper is not None else df


def key_lookup(df: DataFrame, keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """Rows with a wanted key; Spark broadcasts the list if it is small."""
    return df.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def within(limit: int, most: int) -> int:
    """A number of rows from 1 to most; ValueError beyond that, so that nobody takes a part for the whole."""
    if limit > most:
        raise ValueError(f"at most {most} rows at a time, not {limit}")
    return max(1, limit)


def page(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]] = (), limit: int = 200, offset: int = 0, filters: Iterable[Filter] = ()) -> DataFrame:
    """A page of 1 to 10,000 rows (ValueError for more); order: (column, descending), by default the keys."""
    rows = filtered(df, filters)
    by = [F.col(c).desc() if down else F.col(c).asc() for c, down in order] + [F.col(k).asc() for k in keys if k not in {c for c, _ in order}]
    return rows.orderBy(*by).offset(max(0, offset)).limit(within(limit, 10_000))


def page_total(df: DataFrame, filters: Iterable[Filter] = ()) -> DataFrame:
    return filtered(df, filters).agg(F.count(F.lit(1)).alias("total"))


def sorted_nulls_last(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    c = F.col(column)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last())


def top_rows(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    return df.orderBy(*keys).limit(limit)


def count_where(df: DataFrame, where: str | None = None) -> DataFrame:
    return where_fragment(df, where).agg(F.count(F.lit(1)).alias("rows"))


def high_water(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.max(key).alias("max_key")).withColumn("next_id", F.coalesce(F.col("max_key"), F.lit(0)) + 1)
