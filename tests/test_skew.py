"""The skew helpers give the plain result even when every key counts as hot."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracebeam.operators import skew


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def skewed(spark, n=600):
    rng = random.Random(3)
    data = [(i, "hot" if rng.random() < 0.5 else f"k{rng.randrange(9)}", rng.randrange(1000)) for i in range(n)]
    return spark.createDataFrame(data, "id bigint, key string, v bigint")


def test_salted_join_equals_join(spark):
    left = skewed(spark)
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("zz", 4)], "key string, w int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = left.join(right, ["key"], how)
        salted = skew.salted_join(left, right, ["key"], ["id"], how, rows_per_task=20)
        assert rows(salted.select(*plain.columns)) == rows(plain)


def test_null_keys_are_kept_and_spread(spark):
    left = skewed(spark).withColumn("key", F.when(F.col("id") % 3 != 0, F.col("key")))
    right = spark.createDataFrame([("hot", 1), (None, 2)], "key string, w int")
    plain = left.join(right, ["key"], "left")
    salted = skew.salted_join(left, right, ["key"], ["id"], "left", rows_per_task=20)
    assert rows(salted.select(*plain.columns)) == rows(plain)
    hot = skew.hot_keys(left, ["key"], 20)
    salts = skew.salt_many(left, hot, ["key"], ["id"]).where("key IS NULL").select("_salt").distinct()
    assert salts.count() > 50


def test_hot_keys_get_several_slices(spark):
    hot = {r["key"]: r["_slices"] for r in skew.hot_keys(skewed(spark), ["key"], 20).collect()}
    assert hot["hot"] > 5


def test_interval_join_equals_range_join(spark):
    rng = random.Random(5)
    spans = [(i, f"e{i % 2}", lo := rng.randrange(0, 5000), lo + rng.choice([0, 30, 700])) for i in range(80)]
    points = [(i, f"e{i % 2}", rng.choice([100, rng.randrange(0, 6000)])) for i in range(400)]
    left = spark.createDataFrame(spans, "sid int, env string, lo bigint, hi bigint")
    right = spark.createDataFrame(points, "pid int, env string, at bigint")
    for name in ("lo", "hi"):
        left = left.withColumn(name, F.timestamp_seconds(name))
    right = right.withColumn("at", F.timestamp_seconds("at"))
    found = skew.interval_join(left, right, ["env"], "lo", "hi", "at", 60, ["pid"], rows_per_task=3)
    expected = sorted(
        (s, p) for s, e, lo, hi in spans for p, e2, at in points if e == e2 and lo <= at <= hi
    )
    assert sorted((r["sid"], r["pid"]) for r in found.select("sid", "pid").collect()) == expected


def test_running_total_over_blocks(spark):
    df = skewed(spark)
    window = Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.select("id", F.sum("v").over(window).alias("total"))
    blocks = skew.running_total(df, ["key"], ["id"], F.col("v"), "total", block_rows=7)
    assert rows(blocks.select("id", "total")) == rows(plain)


def test_numbered_is_a_global_row_number(spark):
    df = skewed(spark).repartition(7)
    got = skew.numbered(df, ["v", "id"], "n").select("v", "id", "n").collect()
    ordered = sorted(got, key=lambda r: r["n"])
    assert [r["n"] for r in ordered] == list(range(1, 601))
    assert [(r["v"], r["id"]) for r in ordered] == sorted((r["v"], r["id"]) for r in got)


def test_first_per_key_trims_before_the_shuffle(spark):
    df = skew.first_per_key(skewed(spark), ["key"], [F.desc("v"), F.asc("id")], 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before and after the exchange


def test_interval_join_gets_partitions_by_its_pairs(spark, monkeypatch):
    """Few bytes, many pairs: adaptive execution would leave the join in as many tasks as cores."""
    monkeypatch.setattr(skew, "PAIRS_PER_TASK", 50)
    monkeypatch.setattr(skew, "PAIRS_PER_SLICE", 300)
    at = F.timestamp_seconds(F.col("id") * 10)
    points = spark.range(400).select(F.lit("e").alias("env"), "id", at.alias("at"))
    spans = spark.range(200).select(
        F.lit("e").alias("env"), F.col("id").alias("sid"), F.timestamp_seconds(F.col("id") * 20).alias("lo"),
        F.timestamp_seconds(F.col("id") * 20 + 300).alias("hi"),
    )
    found = skew.interval_join(spans, points, ["env"], "lo", "hi", "at", 100, ["id"])
    held = found.groupBy(F.spark_partition_id()).count().collect()
    expected = sum(lo <= at <= lo + 300 for lo in range(0, 4000, 20) for at in range(0, 4000, 10))
    assert sum(r["count"] for r in held) == expected
    assert max(r["count"] for r in held) < expected / 8


def test_interval_join_slices_buckets_by_pairs(spark, monkeypatch):
    """One bucket with few points but many intervals is split as well."""
    monkeypatch.setattr(skew, "PAIRS_PER_TASK", 100)
    monkeypatch.setattr(skew, "PAIRS_PER_SLICE", 1000)
    points = spark.range(40).select(F.lit("e").alias("env"), "id", F.timestamp_seconds(F.lit(5)).alias("at"))
    spans = spark.range(500).select(
        F.lit("e").alias("env"), F.col("id").alias("sid"), F.timestamp_seconds(F.lit(0)).alias("lo"),
        F.timestamp_seconds(F.lit(9)).alias("hi"),
    )
    found = skew.interval_join(spans, points, ["env"], "lo", "hi", "at", 100, ["id"])
    held = found.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in held) == 500 * 40
    assert max(r["count"] for r in held) < 500 * 40 / 4
