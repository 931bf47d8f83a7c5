from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tests.compare import connect, duck_rows, spark_rows
from tidemark.llm import exact_dedup, queries

LONG = "word " * 40_000


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c.lower() if c.isascii() else c for c in t or ""), []).append(i)
    return groups


def test_against_sql(spark, sf_dir):
    df = queries.queries()["op10_exact_dedup"](spark, sf_dir)
    names, expected = duck_rows(connect(sf_dir), queries.oracle_sql()["op10_exact_dedup"])
    assert sorted(df.columns) == names and spark_rows(df) == expected


def test_nulls_ties_and_long_texts(docs):
    rows = [(1, "A b"), (2, "a B"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, LONG), (8, LONG.upper()), (9, LONG + "x"), (None, "q"), (10, "q"), (11, "r"), (11, "r"), (None, "z"), (None, "z")]
    out = exact_dedup.exact_groups(docs(rows)).collect()
    assert len(out) == len(rows)
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in out if r.kept)
    assert kept == [(False, i) for i in (2, 4, 5, 6, 8, 9, 10, 11)] + [(True, 0)]
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[1].keep_id == 2 and by[7].keep_id == 8 and by[3].group_size == 2 and by[9].group_size == 1
    assert all(r.keep_id == 10 for r in out if r.doc_id == 10)


def test_rows_that_stay(docs):
    rows = [(1, "A"), (2, "a"), (3, "b"), (3, "b"), (None, None), (None, ""), (4, "c")]
    df = docs(rows).withColumn("kept", F.lit("other"))
    out = exact_dedup.exact_dedup(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, ""), (2, "a"), (3, "b"), (4, "c")]


def test_empty_and_hot(spark, docs):
    none = docs([]).limit(0)
    assert exact_dedup.exact_groups(none).isEmpty() and exact_dedup.exact_dedup(none).isEmpty()
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("same TEXT")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    out = exact_dedup.exact_groups(hot)
    assert out.where("kept").count() == 1001 and out.agg(F.max("group_size")).first()[0] == 2000
    assert exact_dedup.exact_dedup(hot).count() == 1001


def test_full_hash_only_for_rows_that_may_have_an_equal(docs):
    found = {r._id: r._full for r in exact_dedup.refined(exact_dedup.wrapped(docs(["abc", "xyz", "abc", "a longer one"]), "text", "doc_id", ["doc_id"])).collect()}
    assert found[3] is None and found[0] == found[2] == hashlib.sha256(b"abc").hexdigest()
    assert brute([(1, "a"), (2, "A")]) == {"a": [1, 2]}


NAMES = ["_size", "_slot", "_n", "_full", "_uid", "_row", "_text", "_id", "_keep", "_best", "_h1", "_salt", "_is_hot", "_piece", "_bit", "_bits", "_same_size", "a.b", "Text 2"]


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "A", *range(len(NAMES))), (2, "a", *range(len(NAMES))), (3, "b", *range(len(NAMES)))], ["doc_id", "text", *NAMES])
    out = exact_dedup.exact_dedup(df)
    assert out.columns == df.columns and sorted(out.collect()) == sorted(df.where("doc_id > 1").collect())
    rows = exact_dedup.exact_groups(df, carry=["doc_id", *NAMES]).collect()
    assert sorted(tuple(r) for r in rows) == [(i, *range(len(NAMES)), max(2, i), 2 if i < 3 else 1, i > 1) for i in (1, 2, 3)]


def test_a_full_bitmap_changes_no_result(docs, monkeypatch):
    from tidemark.llm import common

    monkeypatch.setattr(common, "MAX_BITS", 0)
    rows = [(k, f"text {k // 2 % 300} {'x' * (k % 7)}") for k in range(900)]
    out = exact_dedup.exact_groups(docs(rows)).where("kept").collect()
    assert sorted(r.doc_id for r in out) == sorted(max(g) for g in brute(rows).values())
