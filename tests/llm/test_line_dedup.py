from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.compare import connect, duck_rows, spark_rows
from tidemark.llm import line_dedup, queries


def brute(rows, least):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(strip))
    found = {}
    for _, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            found[k] = found.get(k, 0) + 1
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) == "" or found[key(x)] < least]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def run(spark, batches, least):
    docs = batches[0]
    for b in batches[1:]:
        docs = docs.unionByName(b)
    shared, total = line_dedup.shared_lines(batches, spark, min_docs=least)
    return docs, line_dedup.drop_shared_lines(docs, shared, total)


def test_against_sql(spark, sf_dir):
    df = queries.queries()["op5_line_dedup"](spark, sf_dir)
    names, expected = duck_rows(connect(sf_dir), queries.oracle_sql()["op5_line_dedup"])
    assert sorted(df.columns) == names and spark_rows(df) == expected


@pytest.mark.parametrize("parts", [1, 2, 3, 5])
def test_any_number_of_batches(spark, docs, parts):
    rows = [(k, "\n".join([f" Shared {k % 3}\t", "ONE", f"own {k}", "", "é" if k % 2 else "É", *(["late"] if k > 8 else [])])) for k in range(16)]
    rows += [(None, None), (99, ""), (1, rows[1][1]), (50, "ONE\n" + "x y\n" * 5000), (51, "\n\n")]
    made = [docs(rows[k::parts]) for k in range(parts)]
    _, out = run(spark, made, 5)
    assert sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()], key=str) == brute(rows, 5)


def test_settled_lines_go_on_counting(spark, docs):
    runs = line_dedup.LineRuns(spark, min_docs=2)
    for k in range(6):
        runs.add(line_dedup.distinct_keys(docs([(10 * k + j, "hot") for j in range(3)] + [(100 + k, f"own {k}")]), "text", "doc_id", 1))
    shared, total = runs.shared()
    assert [r.n for r in shared.collect()] == [18] and total == 24


def test_batches_keep_filters_and_changes(spark, docs, tmp_path):
    path = f"{tmp_path}/docs"
    docs([(k, f"A\nown {k}") for k in range(40)]).repartition(4).write.parquet(path)
    few = spark.read.parquet(path).where("doc_id < 20").withColumn("text", F.concat("text", F.lit("\nnew")))
    batches = list(line_dedup.in_batches(few))
    assert len(batches) == line_dedup.BATCHES == len(list(line_dedup.in_batches(docs([(1, "x")]))))
    shared, total = line_dedup.shared_lines(batches, spark, min_docs=20)
    assert [r.n for r in shared.collect()] == [20, 20] and total == 60


def test_other_columns_and_empty(spark, docs):
    df = docs([(k, "a\nb") for k in range(3)]).withColumnRenamed("source", "n").withColumnRenamed("n_chars", "n_lines")
    _, out = run(spark, [df], 3)
    assert out.columns == [*df.columns, "n_dropped"] and {r.text for r in out.collect()} == {""}
    _, none = run(spark, [df.limit(0)], 3)
    assert none.isEmpty()


def test_runs_are_merged_without_a_shuffle_and_settled_runs_are_compacted(spark, docs):
    runs = line_dedup.LineRuns(spark, min_docs=3, buckets=3)
    for k in range(8):
        runs.add(line_dedup.distinct_keys(docs([(10 * k + j, f"hot\nline {k // 2}\nown {k} {j}") for j in range(3)]), "text", "doc_id", 1))
        assert len(runs.settled) <= runs.fanout + 1 and all(len(level) < runs.fanout for level in runs.levels)
    plan = runs._merged([*runs.settled, *(run for level in runs.levels for run in level)])._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tidemark_")]
    shared, total = runs.shared()
    assert sorted(r.n for r in shared.collect()) == [6, 6, 6, 6, 24] and total == 8 * (3 * 3)


def test_columns_of_any_name_and_long_texts(spark):
    names = ["_lines", "_keys", "_kept", "_gone", "_row", "_text", "_r1", "_k1", "_at", "_key", "_salt", "_is_hot", "n", "a.b", "Text 2"]
    text = "\n".join(f"line {j % 20_000}" for j in range(60_000))
    df = spark.createDataFrame([(k, "a\nb", *range(len(names))) for k in range(3)] + [(k, text + f"\nown {k}", *range(len(names))) for k in (7, 8, 9)], ["doc_id", "text", *names])
    _, out = run(spark, [df], 3)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    rows = {r.doc_id: r for r in out.collect()}
    assert all(tuple(r)[2 : 2 + len(names)] == tuple(range(len(names))) for r in rows.values())
    assert rows[7].text == "own 7" and rows[7].n_dropped == 60_000 and rows[0].text == ""


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_batches_of_one_reading(spark, docs, batches):
    """The same rows as with a reading for each batch, whatever their number; the plan reads texts once."""
    rows = docs([f"head\nrow {k % 7}\nown {k}\n head " for k in range(60)] + [None, "", "head"])
    want = line_dedup.drop_shared_lines(rows, *line_dedup.shared_lines(line_dedup.in_batches(rows, batches), spark)).collect()
    shared, total = line_dedup.shared_lines_of(rows, batches)
    assert sorted(map(str, line_dedup.drop_shared_lines(rows, shared, total).collect())) == sorted(map(str, want))
    assert total == line_dedup.distinct_keys(rows, "text", "doc_id", 1).count()
