"""Duplicates hidden by formatting: one record of each, with the number of its copies.

Method: exact partial counts show the hot canonical keys (never more than 1024 of them); hot rows go through a salted two-level
aggregation, all others through one shuffle; the smallest identifier represents its set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusverk.functions.keys import letters_and_digits
from korpusverk.operators.skew import HOT_LEAST, HOT_SHARE, hot_join
from korpusverk.plans.runtime import clash_free, cut

SALTS = 64


def record_key(fields: Sequence[Column]) -> Column:
    """128 bits of the fields' canonical forms in sorted order; null where a field has no letter or digit."""
    forms = [letters_and_digits(f) for f in fields]
    whole = F.array_join(F.array_sort(F.array(*forms)), "\u001f")
    some = forms[0] != ""
    for f in forms[1:]:
        some = some & (f != "")
    return F.when(some, F.unhex(F.md5(whole)))


def keyed_rows(df: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """(_id, _key) of every record, written once: the texts are read a single time."""
    src = clash_free(df, id_col, *fields)
    return cut(src.select(F.col(id_col).alias("_id"), record_key([F.col(f) for f in fields]).alias("_key")))


def sets_of(keyed: DataFrame, salts: int = SALTS) -> DataFrame:
    """(_key, _first, _copies) of each key: hot keys by two levels of salted aggregation, the rest by one shuffle."""
    counts = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    least = max(HOT_LEAST, keyed.count() // HOT_SHARE + 1)
    hot = F.broadcast(cut(counts.filter(F.col("_n") >= least).select("_key")))  # at most HOT_SHARE rows
    ends = (F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_copies"))
    rest = keyed.join(hot, "_key", "left_anti").groupBy("_key").agg(*ends)
    one = keyed.join(hot, "_key", "left_semi").groupBy("_key", F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("_salt")).agg(*ends)
    return rest.unionByName(one.groupBy("_key").agg(F.min("_first").alias("_first"), F.sum("_copies").alias("_copies")))


def duplicate_members(df: DataFrame, id_col: str, fields: Sequence[str], salts: int = SALTS) -> DataFrame:
    """(id, _first, _copies) of every record that has a key.

    Records whose fields are null, blank or without any letter or digit have no key and are not returned. Repeated identifiers count as
    records of their own. An empty table gives an empty result. Other columns, whatever their names, are ignored.
    """
    keyed = keyed_rows(df, id_col, fields).filter("_key IS NOT NULL")
    return hot_join(keyed, sets_of(keyed, salts), "_key").select(F.col("_id").alias(id_col), "_first", "_copies")


def duplicate_rows(df: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """(id, _first) of every record but the first of its set: only sets with several records are joined back. Nulls and blanks as in duplicate_members."""
    keyed = keyed_rows(df, id_col, fields).filter("_key IS NOT NULL")
    several = cut(sets_of(keyed).filter("_copies > 1"))
    return hot_join(keyed, several, "_key").filter("_id <> _first").select(F.col("_id").alias(id_col), "_first")


def collapse_duplicates(df: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """One row per set of same records: the smallest identifier and the number of its copies; records without a key stand for themselves."""
    keyed = keyed_rows(df, id_col, fields)
    sets = sets_of(keyed.filter("_key IS NOT NULL")).select(F.col("_first").alias(id_col), F.col("_copies").alias("copies"))
    return sets.unionByName(keyed.filter("_key IS NULL").select(F.col("_id").alias(id_col), F.lit(1).cast("bigint").alias("copies")))
