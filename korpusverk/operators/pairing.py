"""Pairing of parallel versions: wide to long, filters over pairs, content keys, superseding and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusverk.functions import texts as T
from korpusverk.operators.skew import hot_join

CONDITIONS = ("baseline", "human_like", "detector_aware", "detector_evasive")
REPORTED = ("baseline", "human_like", "detector_evasive")
FORMAL = ("formal", "sv_abstracts_adversarial", "Title", "Abstract", "Abstract_")
INFORMAL = ("informal", "consolidated_informal_comments_adversarial", "question", "human_comment", "comment_")


def resolve_conditions(asked: str | Sequence[str]) -> list[str]:
    """all, one name or several, in the canonical order; an unknown name is an error."""
    names = list(CONDITIONS) if asked == "all" else [asked] if isinstance(asked, str) else list(asked)
    unknown = [n for n in names if n not in CONDITIONS]
    if unknown:
        raise ValueError(f"unknown conditions {unknown}; there are {CONDITIONS}")
    return [c for c in CONDITIONS if c in names]


def long_texts(wide: DataFrame, register: str, human: str, prefix: str, conditions: Sequence[str] = CONDITIONS) -> DataFrame:
    """(register, row_id, condition, human, llm): one row per document and condition, one scan."""
    versions = F.array(*[F.struct(F.lit(c).alias("condition"), F.col(prefix + c).alias("llm")) for c in resolve_conditions(conditions)])
    return wide.select(F.lit(register).alias("register"), "row_id", F.col(human).alias("human"), F.explode(versions).alias("v")).select("register", "row_id", "v.condition", "human", "v.llm")


def complete(pairs: DataFrame) -> DataFrame:
    """Pairs of which neither side is null, blank or nan."""
    return pairs.filter(T.non_empty(F.col("human")) & T.non_empty(F.col("llm")))


def in_band(columns: Sequence[str], least: int, most: int) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.length(c).between(least, most), F.lit(False))
    return out


def untouched(columns: Sequence[str], patterns: Sequence[str]) -> Column:
    """No column matches any pattern."""
    out = F.lit(True)
    for c in columns:
        for p in patterns:
            out = out & ~T.matches(F.col(c), p)
    return out


def token_floor(human_tokens: Column, llm_tokens: Column, floor: int) -> Column:
    """Keeps empty sides, drops the pair if a side is shorter than the floor but not empty."""
    return ~(((human_tokens > 0) & (human_tokens < floor)) | ((llm_tokens > 0) & (llm_tokens < floor)))


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key under an explicit order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def none_of(bad: DataFrame, message: str) -> None:
    """Raises ValueError with a few of the rows that should not be there."""
    few = bad.limit(5).collect()
    if few:
        raise ValueError(f"{message}: {[tuple(r) for r in few]}")


def validated_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Each row of left with the one row of right that has its key; a repeated key of right or a row without partner is an error, as is a null key."""
    none_of(duplicate_ids(right, key), f"repeated {key}")
    none_of(left.join(right, key, "left_anti").select(key), f"no row for {key}")
    return left.join(right, key)


def chained_lookup(done: DataFrame, texts: DataFrame, items: DataFrame, doc: str, text: str, group: str) -> DataFrame:
    """(group, doc): done(doc) to its source text, to the items with that text, to their group; the lowest doc of each group. Null texts find nothing."""
    found = done.join(texts.select(doc, text), doc).join(items.select(text, group).distinct(), text)
    return found.groupBy(group).agg(F.min(doc).alias(doc))


def strict_pivot(df: DataFrame, index: str, column: str, value: str, names: Sequence[str]) -> DataFrame:
    """value by index and column, side by side; a cell with several rows is an error."""
    cell = lambda n: F.when(F.count_if(F.col(column) == n) > 1, F.raise_error(F.concat(F.lit(f"several rows for {n} of "), F.coalesce(F.first(index).cast("string"), F.lit("null"))))).otherwise(F.first(F.when(F.col(column) == n, F.col(value)), ignorenulls=True))
    kind = df.schema[value].dataType
    return df.groupBy(index).agg(*[cell(n).cast(kind).alias(n) for n in names])


def content_join(left: DataFrame, right: DataFrame, label: str, text: str, id_col: str, complete: bool = False) -> DataFrame:
    """left rows with the lowest matching id of right under the normalised content key; with complete, a row without a match is an error."""
    keyed = right.select(T.document_key(F.col(label), F.col(text)).alias("_k"), F.col(id_col).alias("match_id")).groupBy("_k").agg(F.min("match_id").alias("match_id"))
    asked = left.withColumn("_k", T.document_key(F.col(label), F.col(text)))
    if complete:
        none_of(asked.join(keyed, "_k", "left_anti").select("_k"), "no match for")
    return hot_join(asked, keyed, "_k").drop("_k")


def supersede(items: DataFrame, id_col: str = "item_id", by: str = "supersedes", strict: bool = False) -> DataFrame:
    """Items that no other item replaces; with strict, an item that replaces an unknown one is an error."""
    if strict:
        none_of(items.filter(F.col(by).isNotNull()).select(F.col(by).alias(id_col)).join(items, id_col, "left_anti"), f"unknown {id_col} superseded")
    return items.join(items.filter(F.col(by).isNotNull()).select(F.col(by).alias(id_col)).distinct(), id_col, "left_anti")


def resume(todo: DataFrame, done: DataFrame, keys: Sequence[str], verdict: str | None = None) -> DataFrame:
    """Rows of todo that are not finished; with verdict, finished means another verdict than UNKNOWN."""
    finished = done.filter(F.col(verdict) != "UNKNOWN") if verdict else done
    return todo.join(finished.select(*keys).distinct(), list(keys), "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old without the keys that new recomputes, with new appended."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def alignment(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Per column the share of equal values among rows of the same key; nulls are equal."""
    joined = a.alias("a").join(b.alias("b"), key)
    return joined.agg(F.count(F.lit(1)).alias("rows"), *[F.avg(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")).cast("int")).alias(c) for c in columns])


def duplicate_ids(df: DataFrame, id_col: str) -> DataFrame:
    return df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def generator_pairs(df: DataFrame, key: Sequence[str], name: str, value: str) -> DataFrame:
    """Every two versions of the same key, once: (key, name_a, name_b, value_a, value_b). An equi-join on the key."""
    a = df.select(*key, F.col(name).alias("name_a"), F.col(value).alias("value_a"))
    b = df.select(*key, F.col(name).alias("name_b"), F.col(value).alias("value_b"))
    return a.join(b, list(key)).filter("name_a < name_b")


def known_values(df: DataFrame, column: str, known: Sequence[str]) -> DataFrame:
    """df, after a check that the column holds nothing but known values and nulls."""
    none_of(df.filter(~F.col(column).isin(*known)).select(column).distinct(), f"unknown {column}")
    return df


def provenance(raw: Column, merged: Column, override: Column) -> tuple[Column, Column]:
    """(value, where it comes from): an override before a merged name before the raw one."""
    return F.coalesce(override, merged, raw), F.when(override.isNotNull(), "assigned").when(merged.isNotNull(), "diva_merged").when(raw.isNotNull(), "diva")
