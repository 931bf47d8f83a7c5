"""Saved runs, work that goes on where it stopped, and rows that reach a database once."""

from __future__ import annotations

import datetime
import time
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.operators import diff, digests
from tidemark.plans import report, runs
from tidemark.plans.report import TableSelection
from tidemark.sources import databases, readers

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
NOW = datetime.datetime(2024, 5, 1)


@pytest.fixture(scope="module")
def two(spark):
    source = spark.range(600).selectExpr("id", "id % 7 AS v", "concat('t', id) AS t")
    return source, source.where("id % 5 > 0").withColumn("v", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("v")))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_pages_of_a_saved_run(spark, two, tmp_path):
    source, target = two
    store = str(tmp_path)
    found = diff.row_diff(source, target, ["id"])
    told = report.compare_tables(spark, {"a": source}, {"a": target}, {"a": TableSelection(["id"])})
    run = runs.save_run(spark, store, "compare", told, NOW, differences={"a": (found, ["id"])})
    saved = spark.read.parquet(f"{store}/differences/{run}/a")
    for kind, want in (("insert", [k for k in range(600) if k % 5 == 0]), ("update", [k for k in range(600) if k % 5 and k % 3 == 0])):
        assert [r.id for r in saved.where(F.col("change_type") == kind).orderBy("place").collect()] == want
        assert [r.place for r in saved.where(F.col("change_type") == kind).orderBy("place").collect()] == list(range(1, len(want) + 1))
    page = runs.saved_page(spark, store, run, "a", source, target, ["id"], "update", 10, 40)
    assert rows(page.drop("place")) == rows(diff.diff_page(source, target, ["id"], "update", 10, 40))
    plan = page._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(change_type), IsNotNull(place)" in plan and ">= 41" in plan
    assert runs.saved_page(spark, store, run, "a", source, target, ["id"], "delete").isEmpty()
    assert [r.inserted for r in runs.report_of(spark, store, run).collect()] == [120]
    history = report.run_history(runs.runs(spark, store), kind="compare").collect()
    assert [(r.run_id, r.status, r.tables) for r in history] == [(run, "Completed", 1)]


def test_a_store_without_runs(spark, tmp_path):
    assert runs.runs(spark, str(tmp_path / "none")).isEmpty()


def test_a_stopped_copy_goes_on(spark, two, tmp_path):
    source, target = two
    path, asked = str(tmp_path / "c"), []

    def make(lows, k):
        asked.append(k)
        if k == 3 and asked.count(3) == 1:
            raise RuntimeError("stopped")
        return runs.digests.within_ranges(source, ["id"], lows, [k])

    with pytest.raises(RuntimeError):
        runs.by_ranges(path, source, ["id"], make, ranges=6)
    assert runs.finished(spark, path).count() < 600
    assert runs.by_ranges(path, source, ["id"], make, ranges=6) == 0
    assert asked[:4] == [0, 1, 2, 3] and asked[4] == 3 and len(asked) == len(set(asked)) + 1  # no finished range is read again
    assert rows(runs.finished(spark, path)) == rows(source)
    compared = str(tmp_path / "d")
    assert runs.resumable_diff(source, target, ["id"], compared, 5, most=2) > 0
    assert runs.resumable_diff(source, target, ["id"], compared, 5) == 0
    assert rows(runs.finished(spark, compared)) == rows(diff.row_diff(source, target, ["id"]))


@pytest.mark.parametrize("keys", [["a"], ["b", "a"]])
def test_a_database_is_read_as_of_one_moment(spark, monkeypatch, keys):
    """Rows written while ranges are read don't show, and nothing stays behind."""
    url = f"jdbc:derby:memory:m{uuid.uuid4().hex};create=true"
    df = spark.createDataFrame([(k, f"t{k % 3}") for k in range(50)], "a long, b string")
    df.write.format("jdbc").options(url=url, dbtable="t", createTableColumnTypes="b varchar(8)", **DERBY).save()
    bounds = databases.key_bounds

    def meanwhile(*a):
        found = bounds(*a)
        databases._execute(spark, url, DERBY, ["DELETE FROM t WHERE \"a\" < 25", "INSERT INTO t SELECT \"a\" + 1000, \"b\" FROM t"])
        return found

    monkeypatch.setattr(databases, "key_bounds", meanwhile)
    assert rows(databases.read_moment(spark, url, "t", keys, 4, DERBY)) == rows(df)
    left = spark.read.format("jdbc").options(url=url, query="SELECT count(*) AS n FROM sys.systables WHERE tabletype = 'T'", **DERBY).load().first()[0]
    assert left == 1 and readers.jdbc(spark, url, "t", properties=DERBY).count() == 50


def test_rows_staged_twice_are_written_once(spark, monkeypatch):
    """Every task's rows reach the staging table twice, as if each had failed after its batch and run again."""
    url = f"jdbc:derby:memory:r{uuid.uuid4().hex};create=true"
    shape = "a long, b string"
    spark.createDataFrame([(0, "x")], shape).write.format("jdbc").options(url=url, dbtable="t", createTableColumnTypes="b varchar(8)", **DERBY).save()
    fill = databases._fill
    monkeypatch.setattr(databases, "_fill", lambda *a: (fill(*a), fill(*a)))
    some = spark.createDataFrame([(k // 2, "same") for k in range(40)], shape)
    assert databases.append(some, url, "t", properties=DERBY) == 40
    assert rows(readers.jdbc(spark, url, "t", properties=DERBY)) == sorted([(0, "x"), *[(k // 2, "same") for k in range(40)]])
    databases._execute(spark, url, DERBY, ["DELETE FROM t WHERE \"a\" < 20 AND \"b\" = 'same'"])
    upserts = spark.createDataFrame([(0, "y"), (5, "z")], shape)
    assert databases.apply_changes(url, "t", ["a"], upserts, properties=DERBY) == {"written": 2, "deleted": 0}
    assert rows(readers.jdbc(spark, url, "t", properties=DERBY)) == [(0, "y"), (5, "z")]


def test_times_without_a_zone_as_keys(spark, tmp_path, monkeypatch):
    # Python's own time zone isn't the session's, and has a gap in these hours
    source = spark.sql("SELECT timestamp_ntz'2024-03-09 22:00:00' + make_dt_interval(0, 0, cast(id AS int) * 3) AS t, id AS v FROM range(200)")
    target = source.where("v % 7 > 0").withColumn("v", F.expr("if(v % 3 = 0, -1, v)"))
    monkeypatch.setenv("TZ", "America/New_York")
    time.tzset()
    try:
        want = rows(diff.row_diff(source, target, ["t"]))
        assert rows(digests.range_diff(source, target, ["t"], ranges=16)) == want
        assert runs.resumable_diff(source, target, ["t"], str(tmp_path / "d"), ranges=9) == 0
        assert rows(runs.finished(spark, str(tmp_path / "d")).select("t", "change_type")) == want
        told = report.compare_tables(spark, {"a": source}, {"a": target}, {"a": TableSelection(["t"])})
        run = runs.save_run(spark, str(tmp_path / "s"), "compare", told, NOW, differences={"a": (diff.row_diff(source, target, ["t"]), ["t"])})
        page = runs.saved_page(spark, str(tmp_path / "s"), run, "a", source, target, ["t"], "update", 20, 20)
        assert page.count() == 20 and page.where("source_v IS NULL OR target_v <> -1").isEmpty()
    finally:
        monkeypatch.undo()
        time.tzset()


def test_copies_keep_every_column_and_take_names_in_any_case(spark, tmp_path):
    df = spark.range(50).selectExpr("id AS Id", "id * 10 AS range", "'x' AS place")
    assert runs.resumable_copy(df, str(tmp_path / "c"), ["ID"], ranges=4) == 0
    assert rows(runs.finished(spark, str(tmp_path / "c"))) == rows(df)


def test_a_saved_page_where_the_source_has_text_keys(spark, tmp_path):
    target = spark.range(100).selectExpr("id", "id AS v")
    source = target.selectExpr("cast(id AS string) AS ID", "if(id % 2 = 0, -1, v) AS v")
    told = report.compare_tables(spark, {"a": source}, {"a": target}, {"a": TableSelection(["id"])})
    run = runs.save_run(spark, str(tmp_path), "compare", told, NOW, differences={"a": (diff.row_diff(source, target, ["id"]), ["id"])})
    page = runs.saved_page(spark, str(tmp_path), run, "a", source, target, ["id"], "update", 10, 5)
    assert [(r.id, r.source_v, r.target_v) for r in page.orderBy("id").collect()] == [(k, -1, k) for k in range(10, 30, 2)]
