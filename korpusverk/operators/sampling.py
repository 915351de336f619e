"""Seeded samples and balanced designs. The order is that of a hash, so it depends neither on partitions nor on the run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusverk.functions import texts as T
from korpusverk.operators.skew import prefix_rank


def seeded(seed: int, *cols: str) -> Column:
    """A hash order that SQL engines share."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def seeded_rank(df: DataFrame, group: Sequence[str], seed: int, key: str) -> DataFrame:
    """Adds _before: how many rows of the group stand earlier in the seeded order; no task holds a whole group."""
    order = F.shiftleft(F.conv(F.substring(seeded(seed, key), 1, 15), 16, 10).cast("bigint"), 2)
    return prefix_rank(df, list(group), order, key)


def sample_rows(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows without replacement."""
    return df.orderBy(seeded(seed, key), key).limit(n)


def first_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def candidate_threads(df: DataFrame, group: str, checked: Sequence[str], banded: str, patterns: Sequence[str], least: int, most: int, rows: int, longest: int) -> DataFrame:
    """Groups of which no row matches any pattern in any checked column, with at least rows rows and one text in the band."""
    hit = F.lit(False)
    for c in checked:
        for p in patterns:
            hit = hit | T.matches(F.col(c), p)
    g = df.filter(F.length(group) <= longest).groupBy(group).agg(F.max(hit.cast("int")).alias("_hit"), F.count(F.lit(1)).alias("n_rows"), F.sum(F.coalesce(F.length(banded).between(least, most), F.lit(False)).cast("int")).alias("n_in_band"))
    return g.filter((F.col("_hit") == 0) & (F.col("n_rows") >= rows) & (F.col("n_in_band") >= 1)).drop("_hit")


def balanced_items(wide: DataFrame, register: str, label: str, human: str, versions: dict[str, str], n: int, seed: int) -> DataFrame:
    """n sampled documents, one item per version of each, numbered in a seeded order within the register."""
    picked = sample_rows(wide, n, seed, "row_id")
    made = F.array(*[F.struct(F.lit(k).alias("condition"), F.lit(k == "human").alias("is_human"), F.col(c).alias("text")) for k, c in ({"human": human} | versions).items()])
    items = picked.select("row_id", F.col(label).alias("context"), F.explode(made).alias("v")).select(F.lit(register).alias("register"), F.col("row_id").alias("source_row"), F.concat(F.lit(register + "-"), "row_id").alias("pair_id"), "context", "v.*")
    return items.withColumn("item_id", F.row_number().over(Window.partitionBy("register").orderBy(seeded(seed, "source_row", "condition"))))


def assign_roles(df: DataFrame, key: str, roles: Sequence[str], per_role: int, seed: int) -> DataFrame:
    """per_role distinct rows for each role."""
    top = sample_rows(df, per_role * len(roles), seed, key)
    top = top.withColumn("_r", F.row_number().over(Window.orderBy(seeded(seed, key), key)) - 1)  # over the sample only
    return top.withColumn("role", F.element_at(F.array(*map(F.lit, roles)), (F.floor(F.col("_r") / per_role) + 1).cast("int"))).drop("_r")


def assign_threads(df: DataFrame, thread: str, key: str, roles: dict[str, Column], seed: int) -> DataFrame:
    """In each thread, one row of its own for each role that meets the role's condition; threads where that cannot be done are left out.

    Roles with the fewest fitting rows in the thread come first; each takes the first of its rows, in a seeded order, that no role before it has taken. Only the
    first len(roles) fitting rows of each role matter, so no more of a thread than that comes together in one place.
    """
    names = list(roles)
    ok = F.array(*[F.struct(F.lit(i).alias("_role"), F.coalesce(c, F.lit(False)).alias("ok")) for i, c in enumerate(roles.values())])
    fits = df.select(F.col(thread).alias("_thread"), F.col(key).alias("_key"), F.explode(ok).alias("f")).select("_thread", "_key", "f.*").filter("ok AND _thread IS NOT NULL")
    sizes = fits.groupBy("_thread", "_role").agg(F.count(F.lit(1)).alias("n"))
    turns = sizes.groupBy("_thread").agg(F.array_sort(F.collect_list(F.struct("n", "_role"))).alias("order"), F.count(F.lit(1)).alias("roles")).filter(F.col("roles") == len(names))
    nearest = F.row_number().over(Window.partitionBy("_thread", "_role").orderBy("h", "_key"))  # cut to a few rows in each task before the shuffle
    few = fits.withColumn("h", seeded(seed, "_key")).withColumn("_r", nearest).filter(F.col("_r") <= len(names))
    options = few.groupBy("_thread", "_role").agg(F.array_sort(F.collect_list(F.struct("h", F.col("_key").alias("k")))).alias("rows"))
    packed = options.groupBy("_thread").agg(F.map_from_entries(F.collect_list(F.struct("_role", "rows"))).alias("by"))
    free = lambda done, role: F.slice(F.filter(F.element_at("by", role), lambda r: ~F.exists(done, lambda x: x["k"] == r["k"])), 1, 1)
    none = F.array().cast(f"array<struct<role:int,k:{df.schema[key].dataType.simpleString()}>>")
    taken = F.aggregate("order", none, lambda done, o: F.concat(done, F.transform(free(done, o["_role"]), lambda r: F.struct(o["_role"].alias("role"), r["k"].alias("k")))))
    done = turns.join(packed, "_thread").withColumn("taken", taken).filter(F.size("taken") == len(names)).select("_thread", F.explode("taken").alias("x"))
    return done.select(F.col("_thread").alias(thread), F.col("x.k").alias(key), F.element_at(F.array(*map(F.lit, names)), F.col("x.role") + 1).alias("role"))


def folds(df: DataFrame, k: int, seed: int, key: str, label: str | None = None) -> DataFrame:
    """fold 0..k-1: by key (a group stays in one fold), or with label evenly within each class."""
    if label is None:
        return df.withColumn("fold", F.pmod(F.conv(F.substring(seeded(seed, key), 1, 8), 16, 10).cast("bigint"), F.lit(k)).cast("int"))
    return seeded_rank(df, [label], seed, key).withColumn("fold", F.pmod("_before", F.lit(k)).cast("int")).drop("_before")
