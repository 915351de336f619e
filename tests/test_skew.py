"""Hot keys against plain joins and ranks."""

from pyspark.sql import functions as F

from korpusverk.operators import skew


def test_prefix_rank_counts_across_buckets(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id"), F.lit(2).alias("w"))
    out = skew.prefix_rank(df, ["g"], skew.hash62("id"), "id", F.col("w"), per_bucket=100).groupBy("g").agg(F.min("_before"), F.max("_before"), F.count_distinct("_before")).collect()
    assert {tuple(r)[1:] for r in out} == {(0, 4998, 2500)}


def test_hot_join_equals_a_join(spark):
    """A third of the rows under one key, nulls, keys that one side lacks."""
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).otherwise(F.lit(None)).cast("bigint").alias("k"))
    right = spark.createDataFrame([(7, "a"), (7, "b"), (4, "c"), (5, "d"), (None, "e")], "k bigint, v string")
    for how in ("inner", "left"):
        got = skew.hot_join(left, right, "k", how)
        want = left.join(right, "k", how)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert "BroadcastHashJoin" in skew.hot_join(left, right, "k")._jdf.queryExecution().toString()
    assert skew.hot_join(left.limit(0), right, "k").count() == 0
