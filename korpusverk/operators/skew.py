"""Building blocks that keep hot keys out of single tasks.

A key is hot when it holds at least 1/HOT_SHARE of all rows, so there are never more than HOT_SHARE hot keys;
that bound, not the data, limits what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusverk.plans.runtime import null_safe_join

HOT_SHARE = 1024
HOT_LEAST = 512


def hot_keys(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """Keys that hold at least rows / HOT_SHARE rows, counted exactly by partial counts."""
    total = df.count() if rows is None else rows
    least = max(HOT_LEAST, total // HOT_SHARE + 1)
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(key)


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", rows: int | None = None) -> DataFrame:
    """left joined (inner or left) to right, which has one row or a few per key.

    Hot keys of left are counted exactly; what right has for them is broadcast (at most HOT_SHARE keys), and all other rows go through one shuffle,
    so a key with a third of all rows stays in the tasks it is read in.
    """
    hot = [r[0] for r in hot_keys(left.filter(F.col(key).isNotNull()), key, left.count() if rows is None else rows).collect()]  # at most HOT_SHARE values
    if not hot:
        return left.join(right, key, how)
    named = left.sparkSession.createDataFrame([(h,) for h in hot], left.select(key).schema)
    few = F.broadcast(right.join(F.broadcast(named), key, "left_semi"))
    warm = left.join(F.broadcast(named), key, "left_semi").join(few, key, how)
    return warm.unionByName(left.join(F.broadcast(named), key, "left_anti").join(right, key, how))


def prefix_rank(df: DataFrame, group: list[str], order: Column, tie: str, weight: Column | None = None, per_bucket: int = 50_000, rows: int | None = None) -> DataFrame:
    """Adds _before: the weight (or the number of rows) of the group's rows that come earlier in the order.

    order must be a uniformly distributed non-negative BIGINT below 2**62 (a hash). Rows are cut into buckets of the order's high bits;
    offsets of buckets come from a small table, so no task ever holds a whole group.
    """
    total = df.count() if rows is None else rows
    bits = max(0, min(20, (max(1, total // per_bucket)).bit_length()))
    weighed = df.withColumn("_o", order).withColumn("_w", F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")).withColumn("_b", F.shiftright("_o", 62 - bits).cast("int"))
    sums = weighed.groupBy(*group, "_b").agg(F.sum("_w").alias("_s"))
    earlier = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, "_b", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_off"))
    within = Window.partitionBy(*group, "_b").orderBy("_o", tie).rowsBetween(Window.unboundedPreceding, -1)
    ranked = weighed.withColumn("_in", F.coalesce(F.sum("_w").over(within), F.lit(0)))
    return null_safe_join(ranked, offsets, [*group, "_b"]).withColumn("_before", F.col("_in") + F.col("_off")).drop("_in", "_off", "_b", "_w", "_o")


def hash62(*cols) -> Column:
    """A uniformly distributed BIGINT in [0, 2**62)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 2)
