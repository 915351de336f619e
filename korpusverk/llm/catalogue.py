"""Queries of the text problems, by problem number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusverk.llm import grouping, languages, mixing, pairs, personal, quality, reading, stuffing, tokens
from korpusverk.plans.runtime import spread, table


INFORMAL, FORMAL = "consolidated_informal_comments_adversarial", "sv_abstracts_adversarial"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_kinds(spread(table(spark, sf_dir, INFORMAL), "row_id"), "row_id", "human_comment")


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.redact_texts(spread(table(spark, sf_dir, INFORMAL), "row_id"), "row_id", "human_comment")


def p2_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = languages.fit(spread(table(spark, sf_dir, "documents"), "doc_id"), "text", "lang")
    return reading.reading_levels(spread(table(spark, sf_dir, FORMAL), "row_id"), "row_id", "Abstract", known)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_levels(spark, sf_dir).filter(F.col("level").isin("easy", "hard")).select("row_id", "level")


def p2_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels beside the stored readability numbers: per level the texts, mean level and the median stored number that is in a sane range."""
    stored = table(spark, sf_dir, "textstat_formal").groupBy(F.col("doc_index").alias("row_id")).agg(F.max("textstat_flesch_reading_ease").alias("stored_ease"), F.max("rough_syllable_count_sv").alias("stored_syllables"))
    joined = p2_levels(spark, sf_dir).join(stored, "row_id", "left")
    sane = F.when(F.col("stored_ease").between(-200, 130), F.col("stored_ease"))
    return joined.groupBy("level").agg(F.count(F.lit(1)).alias("texts"), F.avg("level_score").alias("mean_level"), F.avg("sentence_length").alias("mean_sentence_length"), F.percentile_approx(sane, 0.5).alias("median_stored_ease"), F.count("stored_syllables").alias("with_stored_numbers"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = languages.fit(spread(table(spark, sf_dir, "documents"), "doc_id"), "text", "lang")
    informal = pairs.find_defects(spread(table(spark, sf_dir, INFORMAL), "row_id"), "row_id", "question", "comment_detector_evasive", "informal", known)
    formal = pairs.find_defects(spread(table(spark, sf_dir, FORMAL), "row_id"), "row_id", "Title", "Abstract_detector_evasive", "formal", known, "Keywords")
    return informal.unionByName(formal)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_prose(spread(table(spark, sf_dir, INFORMAL), "row_id"), "row_id", "human_comment")


def p4_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.text_statistics(spread(table(spark, sf_dir, INFORMAL), "row_id"), "row_id", "human_comment")


def p4_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of every abstract, beside the stored character and word counts where there are any."""
    stored = table(spark, sf_dir, "textstat_formal").groupBy(F.col("doc_index").alias("row_id")).agg(F.max("char_count").alias("stored_chars"), F.max("word_count").alias("stored_words"))
    return quality.text_statistics(spread(table(spark, sf_dir, FORMAL), "row_id"), "row_id", "Abstract").join(stored, "row_id", "left")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(spread(table(spark, sf_dir, "documents"), "doc_id"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spread(table(spark, sf_dir, "documents"), "doc_id"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spread(table(spark, sf_dir, "documents"), "doc_id"), table(spark, sf_dir, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.spam_pages(spread(table(spark, sf_dir, "documents"), "doc_id"))


def p9_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.page_features(spread(table(spark, sf_dir, "documents"), "doc_id"))


def queries() -> dict:
    return grouping.queries() | {"p1_found": p1_found, "p1_redacted": p1_redacted, "p2_found": p2_found, "p2_levels": p2_levels, "p2_profile": p2_profile, "p3_found": p3_found, "p4_found": p4_found, "p4_comments": p4_comments, "p4_abstracts": p4_abstracts, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_features": p9_features}


def oracle_sql() -> dict[str, str]:
    return grouping.oracle_sql()
