"""Column masks. Random masks follow from (seed, key, column), so a masked copy compares equal to the next one."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import key_text

KINDS = ("null", "fixed", "random_int", "random_letters", "random_date", "sql_expr")
DAYS = 3650


@dataclass(frozen=True)
class MaskRule:
    pattern: str  #: a column's name, `*`, or a name with one `*` before or after it
    kind: str
    value: Any = None


def matches(pattern: str, column: str) -> bool:
    p, c = pattern.lower(), column.lower()
    if p == "*":
        return True
    if p.endswith("*"):
        return c.startswith(p[:-1])
    return c.endswith(p[1:]) if p.startswith("*") else p == c


def rule_for(column: str, rules: Iterable[MaskRule]) -> MaskRule | None:
    """The first rule that matches."""
    return next((r for r in rules if matches(r.pattern, column)), None)


def digits(seed: str, key: Column, column: str, salt: str = "") -> Column:
    """A number from 0 to 2**32 - 1 from a row's key."""
    text = F.md5(F.concat(F.lit(f"{seed}|"), key, F.lit(f"|{column.lower()}{salt}")))
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("long")


def masked_value(rule: MaskRule, c: str, key: Column, kind: str, seed: str, as_of: str) -> Column:
    match rule.kind:
        case "null":
            return F.lit(None).cast(kind)
        case "fixed":
            return F.lit(rule.value).cast(kind)
        case "random_int":
            top = int(rule.value) if rule.value is not None else 1 << 31
            return F.pmod(digits(seed, key, c), F.lit(max(1, top))).cast(kind)
        case "random_letters":
            n = max(1, int(rule.value if rule.value is not None else 8))
            return F.concat(*[F.char(97 + F.pmod(digits(seed, key, c, f"|{k}"), F.lit(26))) for k in range(n)])
        case "random_date":
            return F.date_sub(F.lit(as_of).cast("date"), F.pmod(digits(seed, key, c), F.lit(DAYS)).cast("int")).cast(kind if kind in ("date", "timestamp", "timestamp_ntz", "string") else "date")
        case "sql_expr":
            return F.expr(str(rule.value)).cast(kind)
    raise ValueError(f"unknown mask: {rule.kind}")


def masked(df: DataFrame, keys: Sequence[str], rules: Sequence[MaskRule], seed: str = "0", as_of: str = "2024-01-01") -> DataFrame:
    key = key_text(df, keys)
    kinds = dict(df.dtypes)
    out = []
    for c in df.columns:
        rule = rule_for(c, rules)
        out.append(masked_value(rule, c, key, kinds[c], seed, as_of).alias(c) if rule else F.col(f"`{c}`"))
    return df.select(*out)


def issues(df: DataFrame, keys: Sequence[str], rules: Sequence[MaskRule]) -> DataFrame:
    """Warnings: random masks on key columns, rules that match no column."""
    found = [("warning", c, f"column {c} is part of the key; a random mask makes other keys of it") for c in df.columns if c in keys and (r := rule_for(c, rules)) and r.kind.startswith("random")]
    found += [("warning", r.pattern, "no column matches this rule") for r in rules if not any(matches(r.pattern, c) for c in df.columns)]
    found += [("error", r.pattern, f"unknown mask: {r.kind}") for r in rules if r.kind not in KINDS or re.fullmatch(r"\**", r.pattern) and r.pattern != "*"]
    return df.sparkSession.createDataFrame(found, "level string, column string, message string")


def _matched(pattern: str, column: Column) -> Column:
    p, c = pattern.lower(), F.lower(column)
    if p == "*":
        return F.lit(True)
    if p.endswith("*"):
        return c.startswith(p[:-1])
    return c.endswith(p[1:]) if p.startswith("*") else c == p


def catalogue_issues(catalogue: DataFrame, rules: Sequence[MaskRule]) -> DataFrame:
    """table, column, message for a catalogue of columns (table, column, is_key): key columns whose first rule is a random mask, and rules that
    match no column of a table. One pass over the catalogue."""
    rule = F.lit(None).cast("string")
    for r in reversed(rules):
        rule = F.when(_matched(r.pattern, F.col("column")), r.kind).otherwise(rule)
    by_column = F.when(F.col("is_key") & rule.startswith("random"), F.col("column"))
    unused = [F.when(~F.bool_or(_matched(r.pattern, F.col("column"))), r.pattern) for r in rules]
    found = catalogue.groupBy("table").agg(F.collect_set(by_column).alias("keys"), F.array_compact(F.array(*unused)).alias("unused"))
    said = lambda names, text: F.transform(names, lambda c: F.struct(c.alias("column"), F.lit(text).alias("message")))
    both = F.concat(said("keys", "a random mask makes other keys of it"), said("unused", "no column matches this rule"))
    return found.select("table", F.inline(both))
