"""Range digests give the rows of row_diff and open only what differs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import diff, digests

SHAPE = "a string, b long, v double, t string"


def rows(df):
    return sorted(map(str, df.collect()))


def two(spark, seed, changed=20):
    r = random.Random(seed)
    base = {(f"k{r.randint(0, 9)}é", n): (float(n), f"t{n}") for n in range(600)}
    other = dict(base)
    for k in r.sample(sorted(base), changed):
        match r.randint(0, 2):
            case 0:
                del other[k]
            case 1:
                other[k] = (other[k][0] + 1, None)
            case 2:
                other[k[0], k[1] + 10_000] = (0.0, "new")
    return [spark.createDataFrame([(*k, *v) for k, v in side.items()], SHAPE) for side in (base, other)]


@pytest.mark.parametrize("keys", [["b"], ["a", "b"]])
@pytest.mark.parametrize("ranges", [1, 40])
def test_same_rows_as_the_whole_comparison(spark, keys, ranges):
    source, target = two(spark, 1)
    assert rows(digests.range_diff(source, target, keys, ranges=ranges)) == rows(diff.row_diff(source, target, keys))


def test_saved_digests(spark, tmp_path):
    source, target = two(spark, 2)
    digests.save(target, str(tmp_path / "d"), ["a", "b"], 50)
    texts = source.select(F.upper("a").alias("A"), F.col("b").cast("string").alias("b"), "v", "t").withColumn("A", F.lower("A"))
    want = rows(diff.row_diff(source, target, ["a", "b"]))
    assert rows(digests.range_diff(source, target, ["a", "b"], str(tmp_path / "d"))) == want
    assert rows(digests.range_diff(texts, target, ["a", "b"], str(tmp_path / "d"))) == want


def test_only_ranges_that_differ_are_opened(spark):
    source = spark.range(10_000).selectExpr("id", "id * 2 AS v")
    target = source.withColumn("v", F.when(F.col("id").isin(17, 9000), -1).otherwise(F.col("v")))
    lows = digests.bounds(target, ["id"], 100)
    sums = [digests.digests(df, ["id"], lows, ["v"]) for df in (source, target)]
    assert len(lows) > 60 and sums[0].where("level = 0").count() == len(lows) + 1
    top = sums[0].orderBy(F.col("level").desc()).first()
    assert (top.level, top.id, top.n) == (digests._height(len(lows) + 1), 0, 10_000)
    ids = digests.differing(*sums, len(lows) + 1)
    assert len(ids) == 2
    opened = digests.within_ranges(target, ["id"], lows, ids)
    assert 2 <= opened.count() < 1000 and {17, 9000} <= {r.id for r in opened.collect()}
    assert digests.differing(sums[0], sums[0], len(lows) + 1) == [] and digests.range_diff(source, source, ["id"], ranges=20).isEmpty()


def test_bounds_reach_the_scan(spark, tmp_path):
    spark.range(5000).selectExpr("id", "id AS v").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    lows = digests.bounds(t, ["id"], 10)
    plan = digests.within_ranges(t, ["id"], lows, [3])._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(IsNull(id)" in plan and "GreaterThanOrEqual(id" in plan


def test_empty_sides(spark):
    source, _ = two(spark, 3)
    none = source.limit(0)
    for a, b in ((source, none), (none, source), (none, none)):
        assert rows(digests.range_diff(a, b, ["b"], ranges=5)) == rows(diff.row_diff(a, b, ["b"]))
