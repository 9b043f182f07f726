"""Joins and rankings when one key holds a third of all rows."""

import pytest
from pyspark.sql import functions as F

from tracklore.operators.skew import hot_keys, salted_join
from tracklore.plans import reports


def uneven(spark, n=3000):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 700).cast("string"))
    )
    return spark.range(n).select("id", F.when(F.col("id") % 50 != 7, key).alias("key"))


def test_hot_keys(spark):
    found = hot_keys(uneven(spark), "key", share=0.05, rows_per_salt=100).collect()
    assert [(r.key, r._salts) for r in found] == [("hot", 10)]
    assert hot_keys(uneven(spark), "key", share=0.05).count() == 0
    assert hot_keys(uneven(spark).limit(0), "key").count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("rows_per_salt", [10, 100, 10**6])
def test_salted_join_equals_plain_join(spark, how, rows_per_salt):
    facts = uneven(spark)
    dims = spark.range(500).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.col("id").alias("d"))
    dims = dims.unionByName(spark.createDataFrame([("hot", -1), ("unused", -2)], "key string, d bigint"))
    salted = salted_join(facts, dims, "key", ["id"], how, rows_per_salt=rows_per_salt).select("id", "key", "d")
    plain = facts.join(dims, "key", how).select("id", "key", "d")
    assert salted.count() == plain.count()
    assert salted.exceptAll(plain).count() == 0


def test_rank_equals_window_rank(spark):
    from pyspark.sql import Window

    plays = uneven(spark).select(
        F.col("key").alias("track_uri"),
        (F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 100)).alias("played_at"),
        F.lit(1).alias("played_time"),
    )
    tracks = plays.filter("track_uri IS NOT NULL").select(F.col("track_uri").alias("uri")).distinct()
    got = reports.rank_in_period(plays, tracks, "day")
    per = reports.plays_per_track(plays.filter("track_uri IS NOT NULL"), "day")
    w = Window.partitionBy("period").orderBy(F.desc("plays"))
    want = per.select("period", "track_uri", "plays", F.rank().over(w).cast("bigint").alias("rank"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
