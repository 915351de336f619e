"""Queries of problems 5 and 6: duplicates hidden by formatting, and splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusverk.llm.duplicates import collapse_duplicates, duplicate_rows
from korpusverk.llm.splits import STAND_INS, assign_splits, link_groups, title_key
from korpusverk.operators.skew import hot_join
from korpusverk.plans.runtime import cut, spread, table

INFORMAL = "consolidated_informal_comments_adversarial"
COPIED = ("question", "human_comment")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = duplicate_rows(spread(table(spark, sf_dir, INFORMAL), "row_id"), "row_id", COPIED)
    return rows.select(F.col("_first").alias("first_row_id"), "row_id")


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_duplicates(spread(table(spark, sf_dir, INFORMAL), "row_id"), "row_id", COPIED)


def thesis_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, id, group_id, link_key, quiz) of every quiz item and embedding row; records without a group are groups of their own."""
    quiz = table(spark, sf_dir, "quiz_master_balanced").select(
        F.lit("quiz").alias("kind"), F.col("item_id").alias("id"), F.coalesce("pair_id", F.concat(F.lit("item:"), "item_id")).alias("group_id"),
        F.when(F.col("register") == "formal", title_key(F.col("context"))).alias("link_key"), (F.coalesce(F.col("register"), F.lit("")) == "formal").alias("formal"))
    pairs = table(spark, sf_dir, "embedding_pair_cosine_formal_human_like").select(
        F.lit("embedding").alias("kind"), F.col("row_id").alias("id"), F.concat(F.when(F.col("source_row").isNull(), "row:").otherwise("formal-"), F.coalesce("source_row", "row_id")).alias("group_id"),
        title_key(F.col("Title")).alias("link_key"), F.lit(False).alias("formal"))
    return quiz.unionByName(pairs)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = thesis_records(spark, sf_dir)
    roots = link_groups(records)
    asked = records.filter("formal AND group_id NOT LIKE 'item:%'").select(F.col("group_id").alias("node")).distinct()
    placed = cut(asked.join(roots, "node"))
    low = placed.groupBy("root").agg(F.min("node").alias("pair_id_a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return hot_join(placed, low, "root").filter("node <> pair_id_a").select("pair_id_a", F.col("node").alias("pair_id_b"))


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every record, and the group it shares it with."""
    records = thesis_records(spark, sf_dir)
    roots = cut(link_groups(records))
    weights = records.groupBy(F.col("group_id").alias("node")).agg(F.count(F.lit(1)).alias("weight"))
    splits = cut(assign_splits(weights.join(roots, "node"), ("train", "validation", "test"), (0.8, 0.1, 0.1)))
    placed = cut(hot_join(cut(records.select("kind", "id", F.col("group_id").alias("node"))), roots, "node"))
    return hot_join(placed, splits, "root").select("kind", "id", F.col("node").alias("group_id"), F.col("root").alias("component"), "split")


def queries() -> dict:
    return {"p5_found": p5_found, "p5_records": p5_records, "p6_found": p6_found, "p6_splits": p6_splits}


#: Lower case of question and human_comment without all but letters and digits.
_KEYS = """SELECT row_id, a || chr(31) || b AS k FROM (SELECT row_id, least(q, h) AS a, greatest(q, h) AS b FROM (
  SELECT row_id, regexp_replace(lower(question), '[^\\p{L}\\p{N}]+', '', 'g') AS q, regexp_replace(lower(human_comment), '[^\\p{L}\\p{N}]+', '', 'g') AS h
  FROM consolidated_informal_comments_adversarial) WHERE q <> '' AND h <> '')"""

#: The groups of each canonical title; their components by repeated joins.
_LINKED = """WITH RECURSIVE rec AS (
  SELECT pair_id AS g, CASE WHEN register = 'formal' THEN regexp_replace(lower(context), '[^\\p{L}\\p{N}]+', '', 'g') END AS k FROM quiz_master_balanced
  UNION SELECT 'formal-' || source_row, regexp_replace(lower(Title), '[^\\p{L}\\p{N}]+', '', 'g') FROM embedding_pair_cosine_formal_human_like WHERE source_row IS NOT NULL),
 link AS (SELECT DISTINCT g, k FROM rec WHERE g IS NOT NULL AND k NOT IN (STANDINS)),
 edge AS (SELECT DISTINCT a.g AS x, b.g AS y FROM link a JOIN link b USING (k)),
 reach AS (SELECT DISTINCT g AS x, g AS y FROM rec WHERE g IS NOT NULL UNION SELECT r.x, e.y FROM reach r JOIN edge e ON r.y = e.x),
 asked AS (SELECT DISTINCT pair_id AS g FROM quiz_master_balanced WHERE register = 'formal' AND pair_id IS NOT NULL),
 low AS (SELECT x AS g, min(y) AS pair_id_a FROM reach JOIN asked ON asked.g = y GROUP BY x)
 SELECT pair_id_a, asked.g AS pair_id_b FROM asked JOIN low USING (g) WHERE pair_id_a <> asked.g""".replace("STANDINS", ", ".join(f"'{x}'" for x in STAND_INS))


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": _LINKED,
        "p5_found": f"WITH r AS ({_KEYS}), f AS (SELECT k, min(row_id) AS first_row_id FROM r GROUP BY k) SELECT first_row_id, row_id FROM r JOIN f USING (k) WHERE row_id <> first_row_id",
        "p5_records": f"WITH r AS ({_KEYS}) SELECT min(row_id) AS row_id, count(*) AS copies FROM r GROUP BY k UNION ALL SELECT row_id, 1 FROM consolidated_informal_comments_adversarial WHERE row_id NOT IN (SELECT row_id FROM r)",
    }
