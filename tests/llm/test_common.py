from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.llm import common


def test_hot_keys_spread_and_all_rows_are_found(spark):
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 20_000).cast("string"))).alias("key"))
    right = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).where("n > 1")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = common.join_hot(rows, right, ["key"], "n", 30_000)
        plain = rows.join(right, "key", "left").select("id", "key", "n", "top")
        assert out.exceptAll(plain).isEmpty() and plain.exceptAll(out).isEmpty()
        plan = out._jdf.queryExecution().executedPlan().toString()
        exchanges = [x for x in plan.split("\n") if "Exchange hashpartitioning(key" in x]
        assert sum("_salt" in x for x in exchanges) >= 2  # both sides of the lookup
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bitmap_misses_no_survivor(spark):
    keys = spark.createDataFrame([(random.Random(1).getrandbits(62) * (-1) ** k + k,) for k in range(3000)], "h long")
    marked = common.mark_survivors(keys.union(spark.range(5000).select(F.xxhash64("id").alias("h"))), "h", common.survivor_bitmap(keys, "h", 20), "may", 20)
    assert keys.join(marked.where("may").select("h").distinct(), "h", "left_anti").isEmpty()
    assert marked.where("not may").count() > 4000
    empty = common.mark_survivors(keys, "h", common.survivor_bitmap(keys.limit(0), "h", 15), "may", 15)
    assert empty.where("may").isEmpty()


def test_bitmaps_grow_with_their_keys_up_to_a_bound():
    assert [common.bitmap_bits(n) for n in (0, 1, 2048, 2049, 10**6, 8 << 20, 10**12)] == [15, 15, 15, 16, 24, 27, 27]
