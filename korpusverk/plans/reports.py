"""Small report queries: previews, audits, prompts, orders and display columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korpusverk.functions import texts as T
from korpusverk.operators import pairing as P
from korpusverk.operators import stats as A
from korpusverk.plans.runtime import table

ORDER = ("human", *P.CONDITIONS)


def previews(spark: SparkSession, d: str) -> DataFrame:
    """The first 120 characters of long texts, marked as cut."""
    t = table(spark, d, "documents").filter("text IS NOT NULL")
    return t.select("doc_id", F.when(F.length("text") > 120, F.concat(F.substring("text", 1, 120), F.lit("..."))).otherwise(F.col("text")).alias("preview"))


def published_delta(spark: SparkSession, d: str) -> DataFrame:
    """Stored character counts against recomputed ones; null where nothing is stored."""
    stored = table(spark, d, "textstat_formal").groupBy(F.col("doc_index").alias("row_id")).agg(F.min("char_count").alias("published"))
    now = table(spark, d, "sv_abstracts_adversarial").select("row_id", F.length("Abstract").cast("bigint").alias("recomputed"))
    return now.join(stored, "row_id", "left").withColumn("delta", F.col("recomputed") - F.col("published"))


def tag_count_merge(spark: SparkSession, d: str) -> DataFrame:
    """Sums of per-document mark counts, through their encoded maps, by language."""
    t = F.col("text")
    cell = T.encode_map(F.create_map(F.lit("comma"), T.literal_count(t, ","), F.lit("period"), T.literal_count(t, "."), F.lit("acl:dash"), T.literal_count(t, "–")))
    m = table(spark, d, "documents").filter("text IS NOT NULL").select("lang", F.explode(T.decode_map(cell)).alias("tag", "n"))
    return m.groupBy("lang", "tag").agg(F.sum("n").alias("n"))


def strict_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Rows per source and register side by side; a repeated cell would be an error."""
    c = table(spark, d, "documents").groupBy("source", "register").agg(F.count(F.lit(1)).alias("n"))
    return P.strict_pivot(c, "source", "register", "n", ("formal", "informal"))


def sentence_fragmentation(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    s = table(spark, d, "documents").filter("text IS NOT NULL").select("source", F.size(T.sentences(t)).alias("s"), T.token_count(t).alias("n"), F.size(T.alpha_tokens(t)).alias("w"), T.literal_count(t, ".").alias("p"))
    g = s.groupBy("source").agg(F.avg("s").alias("sentences"), F.avg("n").alias("tokens"), F.try_divide(F.sum("w"), F.sum("s")).alias("words_per_sentence"), F.try_divide(100.0 * F.sum("p"), F.sum("n")).alias("periods_per_100"))
    return g.select("source", *[F.round(c, 6).alias(c) for c in g.columns[1:]])


def audit_by_condition(spark: SparkSession, d: str) -> DataFrame:
    """Refusals, markdown and empty texts per register and condition."""
    parts = [P.long_texts(table(spark, d, name), reg, human, prefix) for reg, name, _, human, prefix in (P.FORMAL, P.INFORMAL)]
    x = F.col("llm")
    return parts[0].unionByName(parts[1]).groupBy("register", "condition").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(T.non_empty(x), F.lit(False))).alias("empty"), F.count_if(T.refusal_reason(x).isNotNull()).alias("refusals"), F.count_if(T.markdown_count(x) > 0).alias("with_markdown"))


def categorical_order(spark: SparkSession, d: str) -> DataFrame:
    """Conditions in their fixed order, unknown ones after them by name."""
    known = F.array_position(F.array(*map(F.lit, ORDER)), F.coalesce("condition", F.lit("")))
    c = table(spark, d, "quiz_master_balanced").groupBy("condition").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("place", F.row_number().over(Window.orderBy(F.when(known > 0, known).otherwise(1000), "condition")))  # as many rows as conditions


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """The text a judge sees, and the address of the thread."""
    t = table(spark, d, "consolidated_informal_comments_adversarial")
    base = T.with_question(F.col("question"), F.col("human_comment"))
    suffix = F.when(F.col("source") == "reddit", "Skriv kort.").otherwise("")
    link = F.when(F.col("thread_id").isNotNull(), F.format_string("https://forum.invalid/t%s/p%d", F.col("thread_id"), F.col("row_id")))
    return t.select("row_id", T.prompt(base, suffix).alias("prompt"), link.alias("link"))


#: A template for each register and condition: (register, condition, text).
TEMPLATES = [(r, c, f"{opening} {{label}}{style}") for r, opening in (("formal", "Skriv ett abstrakt till uppsatsen:"), ("informal", "Svara på inlägget:")) for c, style in (("baseline", ""), ("human_like", "\n\nSkriv som en människa."), ("detector_aware", "\n\nTexten ska granskas."), ("detector_evasive", "\n\nTexten ska inte kunna kännas igen."))]


def prompt_templates(spark: SparkSession, d: str) -> DataFrame:
    """The prompt of every document of both registers for every condition, from a table of eight templates."""
    t = F.broadcast(spark.createDataFrame(TEMPLATES, "register string, condition string, template string"))  # a settings table
    parts = [table(spark, d, name).select(F.lit(reg).alias("register"), "row_id", F.col(label).alias("label")) for reg, name, label, _, _ in (P.FORMAL, P.INFORMAL)]
    j = parts[0].unionByName(parts[1]).join(t, "register")
    return j.select("register", "row_id", "condition", T.fill(F.col("template"), label=F.col("label")).alias("prompt"))


def kept_by_token_floor(spark: SparkSession, d: str, floor: int = 20) -> DataFrame:
    """Pairs per register and condition, and how many of them the floor on either side's words keeps; empty sides are kept."""
    parts = [P.long_texts(table(spark, d, name), reg, human, prefix, P.REPORTED) for reg, name, _, human, prefix in (P.FORMAL, P.INFORMAL)]
    n = lambda c: F.size(T.alpha_tokens(F.col(c)))
    return parts[0].unionByName(parts[1]).groupBy("register", "condition").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(P.token_floor(n("human"), n("llm"), floor)).alias("kept"))


def first_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first ten theses of an explicit order."""
    from korpusverk.sources import files

    return files.head(table(spark, d, "sv_abstracts_adversarial").filter("Abstract IS NOT NULL").select("row_id", "Year", "Level"), 10, "row_id")


def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    """A one-row summary as (metric, value) rows."""
    from korpusverk.sources import files

    c = table(spark, d, "sv_abstracts_adversarial")
    return files.key_values(c.agg(F.count(F.lit(1)).alias("rows"), F.count("Abstract").alias("abstracts"), F.min("Year").alias("first_year"), F.max("Year").alias("last_year")))


def content_flags(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("human_comment")
    t = table(spark, d, "consolidated_informal_comments_adversarial").filter("human_comment IS NOT NULL")
    return t.select("row_id", T.matches(c, T.LINK).alias("link"), T.matches(c, T.SENSITIVE).alias("sensitive"), c.rlike(T.PICTOGRAPH).alias("pictograph"))


def top_effects(spark: SparkSession, d: str) -> DataFrame:
    """The three largest significant effects of each register and condition, as display columns."""
    from korpusverk.plans import catalogue

    e = catalogue.paired_effects(spark, d).filter("significant")
    r = F.row_number().over(Window.partitionBy("register", "condition").orderBy(F.abs("cohens_dz").desc(), "feature"))
    return e.withColumn("place", r).filter("place <= 3").select("register", "condition", "place", "feature", "cohens_dz", A.effect_band(F.col("cohens_dz")).alias("band"), T.p_text(F.col("p_fdr_bh"), 0.0001).alias("p"), T.heat_colour(F.abs("cohens_dz"), 0.0, 2.0).alias("colour"))


def distance_from_human(spark: SparkSession, d: str) -> DataFrame:
    """Conditions by their median absolute effect, nearest first."""
    from korpusverk.plans import catalogue

    size = F.abs("cohens_dz")
    m = catalogue.paired_effects(spark, d).groupBy("register", "condition").agg(F.round(F.median(size), 6).alias("median_effect"), F.round(F.max(size), 6).alias("largest_effect"), F.round(F.avg(size), 6).alias("mean_effect"))
    return m.withColumn("place", F.row_number().over(Window.partitionBy("register").orderBy("median_effect", "condition")))


def one_sample(spark: SparkSession, d: str) -> DataFrame:
    """Per judge and register: accuracy against chance (exact binomial p and its normal approximation z), and the t value of confidence against 75."""
    from korpusverk.plans import catalogue

    j = catalogue.judged(spark, d)
    g = j.groupBy("judge", "register").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("int")).alias("k"), F.avg("confidence").alias("m"), F.stddev_samp("confidence").alias("s"))
    z = (F.col("k") - F.col("n") * 0.5) / F.sqrt(F.col("n") * 0.25)
    half = 1.959963984540054 * F.col("s") / F.sqrt("n")
    return g.select("judge", "register", "n", "k", F.round(z, 6).alias("z"), F.round(A.mcnemar_p(F.col("k"), F.col("n") - F.col("k")), 6).alias("p_exact"), F.round(F.try_divide(F.col("m") - 75, F.col("s") / F.sqrt("n")), 6).alias("t"), F.round(F.col("m") - half, 6).alias("mean_lo"), F.round(F.col("m") + half, 6).alias("mean_hi"))


def queries() -> dict:
    return {f.__name__: f for f in (previews, published_delta, tag_count_merge, strict_pivot, sentence_fragmentation, audit_by_condition, categorical_order, prompts, prompt_templates, kept_by_token_floor, first_rows, metric_rows, content_flags, top_effects, distance_from_human, one_sample)}


def oracle_sql() -> dict[str, str]:
    from korpusverk.plans import catalogue as C

    hits = lambda m: f"(length(text) - length(replace(text, '{m}', '')))"
    effects = C.ORACLES["paired_effects"]
    return {
        "previews": "SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' ELSE text END AS preview FROM documents WHERE text IS NOT NULL",
        "published_delta": "SELECT s.row_id, CAST(length(Abstract) AS BIGINT) AS recomputed, t.published, length(Abstract) - t.published AS delta FROM sv_abstracts_adversarial s LEFT JOIN (SELECT doc_index, min(char_count) AS published FROM textstat_formal GROUP BY doc_index) t ON s.row_id = t.doc_index",
        "tag_count_merge": f"SELECT lang, unnest(['comma', 'period', 'acl:dash']) AS tag, CAST(unnest([sum({hits(',')}), sum({hits('.')}), sum({hits('–')})]) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL GROUP BY lang",
        "strict_pivot": "SELECT source, CAST(nullif(count(*) FILTER (register = 'formal'), 0) AS BIGINT) AS formal, CAST(nullif(count(*) FILTER (register = 'informal'), 0) AS BIGINT) AS informal FROM documents GROUP BY source",
        "sentence_fragmentation": f"WITH s AS (SELECT source, len({C._sentences_sql('text')}) AS s, {C.TOKENS.format('text')} AS n, len({C.ALPHA.format('text')}) AS w, {hits('.')} AS p FROM documents WHERE text IS NOT NULL) SELECT source, round(avg(s), 6) AS sentences, round(avg(n), 6) AS tokens, round(sum(w) / nullif(sum(s), 0), 6) AS words_per_sentence, round(100.0 * sum(p) / nullif(sum(n), 0), 6) AS periods_per_100 FROM s GROUP BY source",
        "categorical_order": f"WITH c AS (SELECT condition, CAST(count(*) AS BIGINT) AS n, coalesce(nullif(list_position({list(ORDER)}, condition), 0), 1000) AS k FROM quiz_master_balanced GROUP BY condition) SELECT condition, n, CAST(row_number() OVER (ORDER BY k, condition NULLS FIRST) AS INT) AS place FROM c",
        "prompts": "SELECT row_id, concat_ws(chr(10) || chr(10), nullif(concat_ws(chr(10) || chr(10), nullif(trim(question), ''), nullif(trim(human_comment), '')), chr(0)), CASE WHEN source = 'reddit' THEN 'Skriv kort.' END) AS prompt, CASE WHEN thread_id IS NOT NULL THEN 'https://forum.invalid/t' || thread_id || '/p' || row_id END AS link FROM consolidated_informal_comments_adversarial",
        "prompt_templates": "SELECT t.register, row_id, t.condition, replace(template, '{label}', coalesce(label, '')) AS prompt FROM (VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in TEMPLATES) + ") t(register, condition, template) JOIN (SELECT 'formal' AS register, row_id, Title AS label FROM sv_abstracts_adversarial UNION ALL SELECT 'informal', row_id, question FROM consolidated_informal_comments_adversarial) d ON d.register = t.register",
        "kept_by_token_floor": f"WITH n AS (SELECT register, condition, len({C.ALPHA.format('human')}) AS h, len({C.ALPHA.format('llm')}) AS l FROM ({C._long_sql(P.REPORTED)})) SELECT register, condition, CAST(count(*) AS BIGINT) AS pairs, CAST(count(*) FILTER (NOT ((h > 0 AND h < 20) OR (l > 0 AND l < 20))) AS BIGINT) AS kept FROM n GROUP BY ALL",
        "first_rows": "SELECT row_id, Year, Level FROM sv_abstracts_adversarial WHERE Abstract IS NOT NULL ORDER BY row_id LIMIT 10",
        "metric_rows": "SELECT unnest(['rows', 'abstracts', 'first_year', 'last_year']) AS metric, CAST(unnest([count(*), count(Abstract), min(Year), max(Year)]) AS VARCHAR) AS value FROM sv_abstracts_adversarial",
        "content_flags": f"SELECT row_id, regexp_matches(lower(human_comment), '{C.re2(T.LINK)}') AS link, regexp_matches(lower(human_comment), '{C.re2(T.SENSITIVE)}') AS sensitive, regexp_matches(human_comment, '[\\x{{1F000}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}]') AS pictograph FROM consolidated_informal_comments_adversarial WHERE human_comment IS NOT NULL",
        "distance_from_human": f"WITH m AS (SELECT register, condition, round(median(abs(cohens_dz)), 6) AS median_effect, round(max(abs(cohens_dz)), 6) AS largest_effect, round(avg(abs(cohens_dz)), 6) AS mean_effect FROM ({effects}) GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY register ORDER BY median_effect, condition) AS INT) AS place FROM m",
        "one_sample": f"SELECT judge, register, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS k, round((sum(CAST(correct AS INT)) - count(*) * 0.5) / sqrt(count(*) * 0.25), 6) AS z, round(least(1.0, 2 * list_sum(list_transform(range(0, CAST(least(sum(CAST(correct AS INT)), count(*) - sum(CAST(correct AS INT))) AS BIGINT) + 1), lambda k: exp(lgamma(count(*) + 1) - lgamma(k + 1) - lgamma(count(*) - k + 1) - count(*) * ln(2.0))))), 6) AS p_exact, round((avg(confidence) - 75) / (stddev_samp(confidence) / sqrt(count(*))), 6) AS t, round(avg(confidence) - 1.959963984540054 * stddev_samp(confidence) / sqrt(count(*)), 6) AS mean_lo, round(avg(confidence) + 1.959963984540054 * stddev_samp(confidence) / sqrt(count(*)), 6) AS mean_hi FROM {C._JUDGED_SQL} GROUP BY judge, register",
    }
