"""Queries of the corpus-comparison operators, each over its whole tables, beside the SQL that must give the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korpusverk.functions import texts as T
from korpusverk.functions.lexicons import CATEGORIES, FUNCTION_WORDS, NEGATIONS
from korpusverk.operators import annotations as N
from korpusverk.operators import features as X
from korpusverk.operators import pairing as P
from korpusverk.operators import sampling as S
from korpusverk.operators import scoring as J
from korpusverk.operators import stats as A
from korpusverk.plans import counterparts as C
from korpusverk.plans import modelled
from korpusverk.plans.runtime import cut, null_safe_join, spread, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def docs(spark, d) -> DataFrame:
    return spread(table(spark, d, "documents"), "doc_id")


def corpora(spark, d, conditions=P.CONDITIONS) -> DataFrame:
    """(register, row_id, condition, human, llm) of both corpora."""
    parts = [P.long_texts(spread(table(spark, d, name), "row_id"), reg, human, prefix, conditions) for reg, name, _, human, prefix in (P.FORMAL, P.INFORMAL)]
    return parts[0].unionByName(parts[1])


def _long_sql(conditions=P.CONDITIONS) -> str:
    arms = []
    for reg, name, _, human, prefix in (P.FORMAL, P.INFORMAL):
        arms += [f"SELECT '{reg}' AS register, row_id, '{c}' AS condition, {human} AS human, {prefix}{c} AS llm FROM {name}" for c in conditions]
    return " UNION ALL ".join(arms)


NONEMPTY = "({0} IS NOT NULL AND regexp_matches({0}, '[^\\s\\p{{Z}}]') AND NOT regexp_matches({0}, '^[\\s\\p{{Z}}]*[nN][aA][nN][\\s\\p{{Z}}]*$'))"
ALPHA = "coalesce(regexp_extract_all(lower({0}), '\\p{{L}}+'), [])"
SURFACE = "coalesce(regexp_extract_all({0}, '\\p{{L}}+'), [])"
TOKENS = "len(regexp_extract_all({0}, '\\p{{L}}+|\\p{{N}}+|[^\\s\\p{{L}}\\p{{N}}]'))"



def re2(pattern: str) -> str:
    """The pattern with word boundaries that also hold beside Swedish letters."""
    return re.sub(r"\\b(?=\||$)", r"(?:$|[^\\p{L}\\p{N}_])", re.sub(r"(^|\|)\\b", r"\1(?:^|[^\\p{L}\\p{N}_])", pattern))


# --- document features --------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, CAST(len({ALPHA.format('text')}) AS BIGINT) AS n_alpha, CAST(coalesce({TOKENS.format('text')}, 0) AS BIGINT) AS n_tokens, CAST(length(text) AS BIGINT) AS char_count, CAST(len(regexp_extract_all(regexp_replace(lower(text), '[^a-zåäö]', ' ', 'g'), '[aeiouyåäö]+')) AS BIGINT) AS syllables FROM documents WHERE text IS NOT NULL")
def doc_token_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, d).filter("text IS NOT NULL").select("doc_id", F.size(T.alpha_tokens(t)).cast("bigint").alias("n_alpha"), T.token_count(t).cast("bigint").alias("n_tokens"), F.length(t).cast("bigint").alias("char_count"), T.syllables(t).alias("syllables"))


@query(f"WITH w AS (SELECT doc_id, {ALPHA.format('text')} AS w FROM documents) SELECT doc_id, round(CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0.0 END, 6) AS ttr FROM w")
def ttr(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.alpha_tokens(F.col("text")).alias("w")).select("doc_id", r6(X.ttr(F.col("w")), "ttr"))


@query(
    f"""WITH w AS (SELECT doc_id, {SURFACE.format('text')} AS w FROM documents), g AS (SELECT doc_id, len(w) AS n,
 CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END AS b,
 CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [] END AS t FROM w)
SELECT doc_id, round(CASE WHEN len(b) > 0 THEN (len(b) - len(list_distinct(b))) / len(b) ELSE 0.0 END, 6) AS bigrams, round(CASE WHEN len(t) > 0 THEN (len(t) - len(list_distinct(t))) / len(t) ELSE 0.0 END, 6) AS trigrams FROM g"""
)
def ngram_repetition(spark: SparkSession, d: str) -> DataFrame:
    w = docs(spark, d).select("doc_id", T.surface_tokens(F.col("text")).alias("w"))
    return w.select("doc_id", r6(X.ngram_repetition(F.col("w"), 2), "bigrams"), r6(X.ngram_repetition(F.col("w"), 3), "trigrams"))


def _punct_sql() -> str:
    one = lambda m: f"(length(text) - length(replace(text, '{m}', ''))) / {len(m)}"
    cols = [f"round(CASE WHEN n > 0 THEN ({' + '.join(one(x) for x in marks)}) * 100.0 / n ELSE 0.0 END, 6) AS punct_{k}" for k, marks in X.MARKS.items()]
    return f"SELECT doc_id, {', '.join(cols)} FROM (SELECT doc_id, text, {TOKENS.format('text')} AS n FROM documents WHERE text IS NOT NULL)"


@query(_punct_sql())
def punct_rates(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).filter("text IS NOT NULL").select("doc_id", *[r6(c, k) for k, c in X.punctuation(F.col("text")).items()])


@query(f"WITH w AS (SELECT doc_id, {ALPHA.format('text')} AS w FROM documents) SELECT doc_id, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: list_contains({sorted(set(FUNCTION_WORDS))}, x))) / len(w) ELSE 0.0 END, 6) AS function_word_rate FROM w")
def function_word_rate(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.alpha_tokens(F.col("text")).alias("w")).select("doc_id", r6(X.function_word_rate(F.col("w")), "function_word_rate"))


@query(
    f"""WITH w AS (SELECT doc_id, {ALPHA.format('text')} AS w FROM documents) SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0.0 WHEN len(w) < 100 THEN len(list_distinct(w)) / len(w)
 ELSE list_sum(list_transform(range(1, len(w) - 98), lambda i: len(list_distinct(w[i:i + 99])))) / (len(w) - 99) / 100 END, 6) AS mattr FROM w"""
)
def mattr(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.alpha_tokens(F.col("text")).alias("w")).select("doc_id", r6(X.mattr(F.col("w")), "mattr"))


@query("SELECT doc_id, round(MTLD, 6) AS mtld FROM (SELECT doc_id, WORDS AS w FROM documents)")
def mtld(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", r6(X.mtld(T.alpha_tokens(F.col("text"))), "mtld"))


def _lexicon_sql() -> str:
    cols = []
    for k, lex in CATEGORIES.items():
        hits = f"CAST(len(regexp_extract_all(s, '{X.phrase_pattern(lex)}')) AS BIGINT)"
        cols += [f"{hits} AS {k}_count", f"round(CASE WHEN n > 0 THEN {hits} * 100.0 / n ELSE 0.0 END, 6) AS {k}_rate"]
    return f"SELECT doc_id, {', '.join(cols)} FROM (SELECT doc_id, ' ' || array_to_string(w, '  ') || ' ' AS s, len(w) AS n FROM (SELECT doc_id, {ALPHA.format('text')} AS w FROM documents))"


@query(_lexicon_sql())
def lexicon_rates(spark: SparkSession, d: str) -> DataFrame:
    w = X.lexicon_counts(docs(spark, d).select("doc_id", T.alpha_tokens(F.col("text")).alias("w")), "w")
    return w.select("doc_id", *[F.col(f"{k}_count") for k in CATEGORIES], *[r6(T.ratio(F.col(f"{k}_count").cast("double"), F.size("w"), 100), f"{k}_rate") for k in CATEGORIES])


def _sentences_sql(c: str) -> str:
    return f"list_filter(string_split(regexp_replace(trim({c}), '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda x: x <> '')"


_NEGATED = "(?:^|[^\\p{L}\\p{N}_])(?:" + "|".join(NEGATIONS) + ")(?:$|[^\\p{L}\\p{N}_])"


@query(f"WITH s AS (SELECT doc_id, {_sentences_sql('text')} AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(len(s) AS INT) AS n_sentences, round(CASE WHEN len(s) > 0 THEN len(list_filter(s, lambda x: regexp_matches(lower(x), '{_NEGATED}'))) / len(s) ELSE 0.0 END, 6) AS negation_sentence_rate FROM s")
def negation_sentence_rate(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, d).filter("text IS NOT NULL").select("doc_id", F.size(T.sentences(t)).alias("n_sentences"), r6(X.negation_sentence_rate(t), "negation_sentence_rate"))


@query(
    f"""WITH b AS (SELECT doc_id, CAST(len({ALPHA.format('text')}) AS DOUBLE) AS w, CAST(greatest(len({_sentences_sql('text')}), 1) AS DOUBLE) AS s, CAST(len(regexp_extract_all(regexp_replace(lower(text), '[^a-zåäö]', ' ', 'g'), '[aeiouyåäö]+')) AS DOUBLE) AS y,
 CAST(len(list_filter({ALPHA.format('text')}, lambda x: len(regexp_extract_all(x, '[aeiouyåäö]+')) >= 3)) AS DOUBLE) AS h FROM documents WHERE text IS NOT NULL)
SELECT doc_id, round(CASE WHEN w > 0 THEN 206.835 - 1.015 * w / s - 84.6 * y / w ELSE 0.0 END, 6) AS flesch_reading_ease, round(CASE WHEN w > 0 THEN 0.39 * w / s + 11.8 * y / w - 15.59 ELSE 0.0 END, 6) AS flesch_kincaid_grade,
 round(CASE WHEN w > 0 THEN 0.4 * (w / s + 100 * h / w) ELSE 0.0 END, 6) AS gunning_fog, round(CASE WHEN w > 0 THEN 1.043 * sqrt(h * 30 / s) + 3.1291 ELSE 0.0 END, 6) AS smog_index FROM b"""
)
def readability(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).filter("text IS NOT NULL").select("doc_id", *[r6(c, k) for k, c in X.readability(F.col("text")).items()])


@query("SELECT doc_index, CAST(count(*) AS BIGINT) AS stored_rows, round(max(CASE WHEN char_count > 0 THEN word_count / char_count END), 6) AS words_per_char, CAST(count(DISTINCT rough_syllable_count_sv) AS BIGINT) AS syllable_versions FROM textstat_formal GROUP BY doc_index")
def stored_statistics(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "textstat_formal")
    return t.groupBy("doc_index").agg(F.count(F.lit(1)).alias("stored_rows"), r6(F.max(F.when(F.col("char_count") > 0, F.col("word_count") / F.col("char_count"))), "words_per_char"), F.count_distinct("rough_syllable_count_sv").alias("syllable_versions"))


# --- normalisers and text predicates ------------------------------------------------------------------------------------------


@query(C.normalize_formal(_long_sql()))
def normalize_formal(spark: SparkSession, d: str) -> DataFrame:
    long = corpora(spark, d).filter("register = 'formal' AND llm IS NOT NULL")
    return long.select("row_id", "condition", T.normalize_formal(F.col("llm")).alias("text"), (T.markdown_count(F.col("llm")) > 0).alias("markdown"))


@query(C.NORMALIZE_INFORMAL)
def normalize_informal(spark: SparkSession, d: str) -> DataFrame:
    t = spread(table(spark, d, P.INFORMAL[1]), "row_id").filter("human_comment IS NOT NULL")
    c = F.col("human_comment")
    n = T.normalize_informal(c)
    return t.select("row_id", n.alias("text"), T.normalize_informal(c, True).alias("without_quotes"), T.artefacts(c).alias("artefact"), (n != c).alias("changed"), (n != F.trim(c)).alias("changed_in_substance"))


@query(
    "SELECT row_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(human_comment, '&gt;', '>'), '&lt;', '<'), '&quot;', '\"', 'g'), '&#0?39;|&apos;', '''', 'g'), '&nbsp;', ' ', 'g'), '&amp;', '&', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS text FROM consolidated_informal_comments_adversarial WHERE human_comment IS NOT NULL"
)
def unescaped(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, P.INFORMAL[1]).filter("human_comment IS NOT NULL")
    return t.select("row_id", F.trim(F.regexp_replace(T.unescape(F.col("human_comment")), r"[ \t\r\n]+", " ")).alias("text"))


def _refusal_case() -> str:
    def plain(p: str) -> str:
        p = re2(p.replace("(?iU)", "")).replace("\\b", "").replace("\\w", "[\\p{L}\\p{N}_]").replace("'", "''")
        return "(?i)" + p

    return "CASE " + " ".join(f"WHEN regexp_matches(head, '{plain(p)}') THEN '{w.replace(chr(39), chr(39) * 2)}'" for p, w in T.REFUSALS) + " END"


def _refusal_sql() -> str:
    return f"SELECT * FROM (SELECT register, row_id, condition, {_refusal_case()} AS reason FROM (SELECT register, row_id, condition, substr(llm, 1, 300) AS head FROM ({_long_sql()}) WHERE llm IS NOT NULL)) WHERE reason IS NOT NULL"


@query(_refusal_sql())
def refusal_flags(spark: SparkSession, d: str) -> DataFrame:
    return corpora(spark, d).filter("llm IS NOT NULL").select("register", "row_id", "condition", T.refusal_reason(F.col("llm")).alias("reason")).filter("reason IS NOT NULL")


@query(
    "SELECT register, condition, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (regexp_matches(coalesce(llm, ''), '[*#\\\\`]') OR contains(coalesce(llm, ''), 'Nyckelord')) AS BIGINT) AS with_residue, round(avg(length(llm)), 6) AS mean_chars FROM ("
    + _long_sql()
    + ") GROUP BY register, condition"
)
def residual_format(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce(F.col("llm"), F.lit(""))
    return corpora(spark, d).groupBy("register", "condition").agg(F.count(F.lit(1)).alias("n"), F.count_if(t.rlike(r"[*#\\`]") | t.contains("Nyckelord")).alias("with_residue"), r6(F.avg(F.length("llm")), "mean_chars"))


@query("SELECT generator, CAST(count(*) AS BIGINT) AS n, " + ", ".join(f"round(avg(CASE WHEN regexp_matches(lower(text), '{p}') THEN 1 ELSE 0 END) * 100, 6) AS {k}" for k, p in T.CUES.items()) + " FROM quiz_master_balanced WHERE text IS NOT NULL GROUP BY generator")
def cue_profile(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "quiz_master_balanced").filter("text IS NOT NULL")
    return t.groupBy("generator").agg(F.count(F.lit(1)).alias("n"), *[r6(F.avg(T.matches(F.col("text"), p).cast("int")) * 100, k) for k, p in T.CUES.items()])


@query(
    f"""SELECT row_id, CASE WHEN human_link IS NOT NULL THEN regexp_extract(human_link, '/r/([^/]+)', 1) END AS forum, substr(sha1(human_link), 1, 4) AS tag, CASE WHEN human_link IS NOT NULL THEN CAST(length(regexp_extract(human_link, '/([A-Za-z0-9_]+)/?$', 1)) AS BIGINT) END AS id_length,
 replace(replace(replace(replace(question, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped, trim(regexp_replace(coalesce(topic, ''), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) || '|||' || trim(regexp_replace(coalesce(question, ''), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS doc_key,
 lower(source) = reverse(lower(source)) AS palindrome FROM consolidated_informal_comments_adversarial"""
)
def link_parts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, P.INFORMAL[1])
    link = F.col("human_link")
    return t.select("row_id", F.regexp_extract(link, "/r/([^/]+)", 1).alias("forum"), F.substring(F.sha1(link), 1, 4).alias("tag"), F.length(F.regexp_extract(link, "/([A-Za-z0-9_]+)/?$", 1)).cast("bigint").alias("id_length"), T.html_escape(F.col("question")).alias("escaped"), T.document_key(F.col("topic"), F.col("question")).alias("doc_key"), (F.lower("source") == F.reverse(F.lower("source"))).alias("palindrome"))


def _date_sql() -> str:
    months = " ".join(f"WHEN '{m}' THEN '{i:02d}'" for m, i in T.MONTHS.items())
    rx = "(?i)(\\d{1,2})\\s+([a-zåäö]+)\\s+(\\d{4})"
    return f"""WITH p AS (SELECT row_id, post_date, regexp_extract(post_date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AS iso, regexp_extract(post_date, '{rx}', 1) AS dd, CASE substr(lower(regexp_extract(post_date, '{rx}', 2)), 1, 3) {months} END AS mm, regexp_extract(post_date, '{rx}', 3) AS yy FROM consolidated_informal_comments_adversarial)
SELECT row_id, CAST(coalesce(try_cast(nullif(iso, '') AS DATE), try_cast(yy || '-' || mm || '-' || lpad(dd, 2, '0') AS DATE)) AS VARCHAR) AS posted FROM p WHERE post_date IS NOT NULL"""


@query(_date_sql())
def post_dates(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, P.INFORMAL[1]).filter("post_date IS NOT NULL")
    return t.select("row_id", T.parse_date(F.col("post_date")).cast("string").alias("posted"))


@query(f"SELECT row_id, source FROM consolidated_informal_comments_adversarial WHERE {NONEMPTY.format('human_comment')} AND lower(trim(human_comment)) NOT IN ('[deleted]', '[removed]') AND contains(question, '?') AND epoch(ingested_at) < 1735689600")
def filtered_replies(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, P.INFORMAL[1])
    c = F.col("human_comment")
    return t.filter(T.non_empty(c) & ~F.lower(F.trim(c)).isin("[deleted]", "[removed]") & F.col("question").contains("?") & (F.unix_seconds(F.col("ingested_at").cast("timestamp")) < 1735689600)).select("row_id", "source")


@query("SELECT row_id, source, topic FROM consolidated_informal_comments_adversarial WHERE contains(lower(concat_ws(' ', topic, question, human_comment)), 'hyresvärd') AND source = 'flashback'")
def text_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, P.INFORMAL[1]).filter(F.lower(F.concat_ws(" ", "topic", "question", "human_comment")).contains("hyresvärd") & (F.col("source") == "flashback")).select("row_id", "source", "topic")


# --- pairing and relational ---------------------------------------------------------------------------------------------------


@query(f"SELECT register, condition, CAST(count(*) AS BIGINT) AS pairs, CAST(sum(length(human)) AS BIGINT) AS human_chars, CAST(sum(length(llm)) AS BIGINT) AS llm_chars FROM ({_long_sql()}) WHERE {NONEMPTY.format('human')} AND {NONEMPTY.format('llm')} GROUP BY register, condition")
def paired_lengths(spark: SparkSession, d: str) -> DataFrame:
    return P.complete(corpora(spark, d)).groupBy("register", "condition").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.length("human")).cast("bigint").alias("human_chars"), F.sum(F.length("llm")).cast("bigint").alias("llm_chars"))


@query(
    f"""SELECT row_id, question FROM consolidated_informal_comments_adversarial WHERE coalesce(length(human_comment) BETWEEN 80 AND 600, false) AND coalesce(length(comment_baseline) BETWEEN 80 AND 600, false) AND length(question) <= 300
 AND NOT regexp_matches(lower(coalesce(human_comment, '')), '{re2(T.BLOCKED)}') AND NOT regexp_matches(lower(coalesce(human_comment, '')), '{re2(T.LINK)}')"""
)
def candidate_filter(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, P.INFORMAL[1])
    return t.filter(P.in_band(["human_comment", "comment_baseline"], 80, 600) & (F.length("question") <= 300) & P.untouched(["human_comment"], [T.BLOCKED, T.LINK])).select("row_id", "question")


@query(
    f"""SELECT question, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(CASE WHEN coalesce(length(human_comment) BETWEEN 40 AND 600, false) THEN 1 ELSE 0 END) AS BIGINT) AS n_in_band FROM consolidated_informal_comments_adversarial WHERE length(question) <= 400 GROUP BY question
 HAVING count(*) >= 4 AND n_in_band >= 1 AND max(CASE WHEN regexp_matches(lower(coalesce(human_comment, '')), '{re2(T.BLOCKED + '|' + T.LINK + '|' + T.SENSITIVE)}') OR regexp_matches(lower(question), '{re2(T.BLOCKED + '|' + T.LINK + '|' + T.SENSITIVE)}') THEN 1 ELSE 0 END) = 0"""
)
def group_universal_filter(spark: SparkSession, d: str) -> DataFrame:
    t = spread(table(spark, d, P.INFORMAL[1]), "row_id")
    return S.candidate_threads(t, "question", ["question", "human_comment"], "human_comment", [T.BLOCKED, T.LINK, T.SENSITIVE], 40, 600, 4, 400)


@query("SELECT row_id, thread_id FROM (SELECT row_id, thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY ingested_at, row_id) AS r FROM consolidated_informal_comments_adversarial WHERE thread_id IS NOT NULL) WHERE r <= 5")
def first_k_per_group(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, P.INFORMAL[1]).filter("thread_id IS NOT NULL")
    return S.first_k(t, ["thread_id"], [F.col("ingested_at"), F.col("row_id")], 5).select("row_id", "thread_id")


@query("SELECT item_id, register, generator FROM quiz_master_balanced q WHERE NOT EXISTS (SELECT 1 FROM quiz_master_balanced s WHERE s.supersedes = q.item_id)")
def supersede(spark: SparkSession, d: str) -> DataFrame:
    return P.supersede(table(spark, d, "quiz_master_balanced")).select("item_id", "register", "generator")


@query(
    """SELECT e.row_id, min(s.row_id) AS match_id FROM embedding_pair_cosine_formal_human_like e JOIN sv_abstracts_adversarial s
 ON trim(regexp_replace(coalesce(e.Title, ''), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) = trim(regexp_replace(coalesce(s.Title, ''), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) GROUP BY e.row_id"""
)
def content_key_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embedding_pair_cosine_formal_human_like").withColumn("label", F.lit(""))
    s = table(spark, d, "sv_abstracts_adversarial").withColumn("label", F.lit(""))
    return P.content_join(e, s, "label", "Title", "row_id").select("row_id", "match_id")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def anti_resume(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return P.resume(table(spark, d, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("SELECT q.item_id FROM quiz_master_balanced q WHERE q.register = 'formal' AND EXISTS (SELECT 1 FROM embedding_pair_cosine_formal_human_like e WHERE e.source_row = q.source_row AND e.cosine_similarity >= 0.7)")
def semi_matched(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embedding_pair_cosine_formal_human_like").filter("cosine_similarity >= 0.7").select("source_row")
    return table(spark, d, "quiz_master_balanced").filter("register = 'formal'").join(e, "source_row", "left_semi").select("item_id")


@query(
    """SELECT coalesce(a.source, b.source) AS source, coalesce(a.n, 0) AS swedish, coalesce(b.n, 0) AS others FROM (SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents WHERE lang = 'sv' AND source IS NOT NULL GROUP BY source) a
 FULL JOIN (SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents WHERE lang <> 'sv' AND source IS NOT NULL GROUP BY source) b ON a.source = b.source"""
)
def outer_join_fill(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).filter("source IS NOT NULL")
    a, b = (x.filter(c).groupBy("source").agg(F.count(F.lit(1)).alias(n)) for c, n in (("lang = 'sv'", "swedish"), ("lang <> 'sv'", "others")))
    return a.join(b, "source", "full_outer").select("source", F.coalesce("swedish", F.lit(0)).alias("swedish"), F.coalesce("others", F.lit(0)).alias("others"))


@query(
    """SELECT row_id, coalesce(o.v, m.v, s.Topic_Category) AS topic, CASE WHEN o.v IS NOT NULL THEN 'assigned' WHEN m.v IS NOT NULL THEN 'diva_merged' WHEN s.Topic_Category IS NOT NULL THEN 'diva' END AS origin FROM sv_abstracts_adversarial s
 LEFT JOIN (SELECT DISTINCT Topic_Category AS k, upper(Topic_Category) AS v FROM sv_abstracts_adversarial WHERE Topic_Category < 'N') m ON s.Topic_Category = m.k
 LEFT JOIN (SELECT row_id AS k, 'Övrigt' AS v FROM sv_abstracts_adversarial WHERE row_id % 10 = 3) o ON s.row_id = o.k"""
)
def provenance(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sv_abstracts_adversarial").select("row_id", "Topic_Category")
    merged = s.filter("Topic_Category < 'N'").select("Topic_Category", F.upper("Topic_Category").alias("merged")).distinct()
    override = s.filter("row_id % 10 = 3").select("row_id", F.lit("Övrigt").alias("override"))
    j = s.join(merged, "Topic_Category", "left").join(override, "row_id", "left")
    value, origin = P.provenance(F.col("Topic_Category"), F.col("merged"), F.col("override"))
    return j.select("row_id", value.alias("topic"), origin.alias("origin"))


@query("SELECT a.source_row, a.generator AS name_a, b.generator AS name_b, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT source_row, pair_id, generator FROM quiz_master_balanced) a JOIN (SELECT DISTINCT source_row, pair_id, generator FROM quiz_master_balanced) b ON a.pair_id = b.pair_id AND a.generator < b.generator GROUP BY ALL")
def generator_pairs(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "quiz_master_balanced").select("pair_id", "source_row", "generator").distinct()
    return P.generator_pairs(q, ["pair_id", "source_row"], "generator", "generator").groupBy("source_row", "name_a", "name_b").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT t.source, c.condition, k.temp FROM mix_targets t CROSS JOIN (VALUES ('baseline'), ('human_like'), ('detector_aware'), ('detector_evasive')) c(condition) CROSS JOIN (VALUES (0.15), (1.0)) k(temp)")
def config_product(spark: SparkSession, d: str) -> DataFrame:
    made = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(t).alias("temp")) for c in P.CONDITIONS for t in (0.15, 1.0)]))
    return table(spark, d, "mix_targets").select("source", made.alias("c")).select("source", "c.condition", F.col("c.temp").cast("double").alias("temp"))


@query("SELECT CAST(count(*) AS BIGINT) AS rows, round(avg(CASE WHEN s.Title IS NOT DISTINCT FROM e.Title THEN 1 ELSE 0 END), 6) AS title FROM (SELECT row_id, Title FROM sv_abstracts_adversarial) s JOIN (SELECT source_row AS row_id, Title FROM embedding_pair_cosine_formal_human_like) e ON s.row_id = e.row_id")
def alignment_audit(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "sv_abstracts_adversarial").select("row_id", "Title")
    b = table(spark, d, "embedding_pair_cosine_formal_human_like").select(F.col("source_row").alias("row_id"), "Title")
    return P.alignment(a, b, "row_id", ["Title"]).select("rows", r6(F.col("Title"), "title"))


@query("SELECT row_id, source_row FROM (SELECT row_id, source_row, row_number() OVER (PARTITION BY source_row ORDER BY row_id DESC) AS r FROM embedding_pair_cosine_formal_human_like) WHERE r = 1")
def keep_last(spark: SparkSession, d: str) -> DataFrame:
    return P.keep_one(table(spark, d, "embedding_pair_cosine_formal_human_like"), ["source_row"], [F.col("row_id").desc()]).select("row_id", "source_row")


@query("WITH new AS (SELECT row_id, Title FROM sv_abstracts_adversarial WHERE Year >= 2010) SELECT row_id, 'old' AS version FROM sv_abstracts_adversarial WHERE row_id NOT IN (SELECT row_id FROM new) UNION ALL SELECT row_id, 'new' FROM new")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "sv_abstracts_adversarial").select("row_id", "Year")
    return P.upsert(old.select("row_id", F.lit("old").alias("version")), old.filter("Year >= 2010").select("row_id", F.lit("new").alias("version")), ["row_id"])


@query("SELECT context, CAST(count(*) AS BIGINT) AS n FROM quiz_master_balanced GROUP BY context HAVING count(*) > 4")
def duplicate_guard(spark: SparkSession, d: str) -> DataFrame:
    return P.duplicate_ids(table(spark, d, "quiz_master_balanced"), "context").filter("n > 4")


# --- aggregations, windows, order, sets ---------------------------------------------------------------------------------------


@query("SELECT generator, CAST(count(*) FILTER (condition = 'human') AS BIGINT) AS human, " + ", ".join(f"CAST(count(*) FILTER (condition = '{c}') AS BIGINT) AS {c}" for c in P.CONDITIONS) + " FROM quiz_master_balanced GROUP BY generator")
def crosstab(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "quiz_master_balanced").groupBy("generator").pivot("condition", ["human", *P.CONDITIONS]).count().na.fill(0)


@query("SELECT source, " + ", ".join(f"round(avg(CASE WHEN lang = '{x}' THEN 1.0 ELSE 0.0 END), 6) AS {x}" for x in ("sv", "en", "no", "da", "de", "fi", "und")) + ", CAST(count(DISTINCT thread_id) AS BIGINT) AS threads, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY source")
def label_proportions(spark: SparkSession, d: str) -> DataFrame:
    share = [r6(F.avg(F.when(F.col("lang") == x, 1.0).otherwise(0.0)), x) for x in ("sv", "en", "no", "da", "de", "fi", "und")]
    return docs(spark, d).groupBy("source").agg(*share, F.count_distinct("thread_id").alias("threads"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS sd, round(stddev_pop(value), 6) AS sd_pop, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(CASE WHEN value > 50 THEN 1 ELSE 0 END), 6) AS above FROM events GROUP BY event_type")
def value_summary(spark: SparkSession, d: str) -> DataFrame:
    v, e = F.col("value"), table(spark, d, "events")
    g = e.groupBy("event_type").agg(r6(F.min(v), "low"), r6(F.max(v), "high"), r6(F.avg(v), "mean"), r6(F.stddev_samp(v), "sd"), r6(F.stddev_pop(v), "sd_pop"), r6(F.avg((v > 50).cast("int")), "above"))
    q = A.quantiles(e, ["event_type"], "value", {"median": 0.5, "p90": 0.9, "p95": 0.95})
    return null_safe_join(g, q.select("event_type", *[r6(F.col(c), c) for c in ("median", "p90", "p95")]), ["event_type"], "left")


@query("WITH c AS (SELECT lang, substr(w, 1, 1) AS tag, count(*) AS n FROM (SELECT doc_id, lang, unnest(" + ALPHA.format("text") + ") AS w FROM documents) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, tag) AS r FROM c) SELECT lang, CASE WHEN r <= 5 THEN tag ELSE 'OTHER' END AS tag, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY ALL")
def top_n_other(spark: SparkSession, d: str) -> DataFrame:
    c = docs(spark, d).select("lang", F.explode(T.alpha_tokens(F.col("text"))).alias("w")).groupBy("lang", F.substring("w", 1, 1).alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    r = c.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "tag")))
    return r.groupBy("lang", F.when(F.col("r") <= 5, F.col("tag")).otherwise("OTHER").alias("tag")).agg(F.sum("n").alias("n"))


@query("WITH w AS (SELECT doc_id, source, " + ALPHA.format("text") + " AS w FROM documents), t AS (SELECT doc_id, source, len(w) AS total, len(list_filter(w, lambda x: length(x) > 6)) AS long FROM w) SELECT source, round(sum(CASE WHEN total > 0 THEN long / total END) / count(*) FILTER (total > 0), 6) AS share, round(sum(CASE WHEN total >= 30 THEN long * 100.0 / total END) / count(*) FILTER (total >= 30), 6) AS per_100 FROM t GROUP BY source")
def macro_proportion(spark: SparkSession, d: str) -> DataFrame:
    w = docs(spark, d).select("source", T.alpha_tokens(F.col("text")).alias("w"))
    t = w.select("source", F.size("w").alias("total"), F.size(F.filter("w", lambda x: F.length(x) > 6)).alias("long"))
    share = lambda least, k: F.sum(F.when(F.col("total") >= least, F.col("long") * k / F.col("total"))) / F.nullif(F.count_if(F.col("total") >= least), F.lit(0))
    return t.groupBy("source").agg(r6(share(1, 1.0), "share"), r6(share(30, 100.0), "per_100"))


@query("SELECT coalesce(l_returnflag, '_ALL_') AS flag, coalesce(l_linestatus, '_ALL_') AS status, CAST(count(*) AS BIGINT) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def subtotals(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("l_quantity"), "mean"))
    return g.select(F.coalesce("l_returnflag", F.lit("_ALL_")).alias("flag"), F.coalesce("l_linestatus", F.lit("_ALL_")).alias("status"), "n", "mean")


@query("SELECT pair_id, arg_min(text, item_id) FILTER (condition = 'human' AND text IS NOT NULL) AS human, arg_min(text, item_id) FILTER (condition = 'baseline' AND text IS NOT NULL) AS baseline FROM quiz_master_balanced GROUP BY pair_id")
def first_value_pivot(spark: SparkSession, d: str) -> DataFrame:
    first = lambda c: F.min_by("text", F.when((F.col("condition") == c) & F.col("text").isNotNull(), F.col("item_id"))).alias(c)
    return table(spark, d, "quiz_master_balanced").groupBy("pair_id").agg(first("human"), first("baseline"))


@query("SELECT thread_id, CAST(dense_rank() OVER (ORDER BY first) AS BIGINT) AS code FROM (SELECT thread_id, min(row_id) AS first FROM consolidated_informal_comments_adversarial WHERE thread_id IS NOT NULL GROUP BY thread_id)")
def factorize(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, P.INFORMAL[1]).filter("thread_id IS NOT NULL").groupBy("thread_id").agg(F.min("row_id").alias("first"))
    return A.cumulate(g.withColumn("n", F.lit(1)), [], "first", ["n"]).select("thread_id", (F.col("below_n") + 1).cast("bigint").alias("code"))


@query("SELECT thread_id, coalesce(min_by(question, row_id) FILTER (question IS NOT NULL), '(utan fråga)') AS question, CAST(count(*) AS BIGINT) AS n FROM consolidated_informal_comments_adversarial GROUP BY thread_id")
def question_per_thread(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, P.INFORMAL[1]).groupBy("thread_id").agg(F.coalesce(F.min_by("question", F.when(F.col("question").isNotNull(), F.col("row_id"))), F.lit("(utan fråga)")).alias("question"), F.count(F.lit(1)).alias("n"))


@query("SELECT source, topic, n FROM (SELECT source, topic, CAST(count(*) AS BIGINT) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, topic) AS r FROM consolidated_informal_comments_adversarial GROUP BY source, topic) WHERE r <= 8")
def top_topics(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, P.INFORMAL[1]).groupBy("source", "topic").agg(F.count(F.lit(1)).alias("n"))
    return S.first_k(c, ["source"], [F.desc("n"), F.col("topic")], 8)


def _freq_sql(side: str) -> str:
    words = f"SELECT register, condition, unnest({ALPHA.format(side)}) AS w FROM ({_long_sql(P.REPORTED)})"
    return f"(SELECT register, condition, w, CAST(count(*) AS BIGINT) AS n FROM ({words}) WHERE NOT list_contains({sorted(set(FUNCTION_WORDS))}, w) GROUP BY ALL)"


def _top_words(spark, d, side: str, n: int = 50) -> DataFrame:
    stop = sorted(set(FUNCTION_WORDS))
    c = corpora(spark, d, P.REPORTED).select("register", "condition", F.explode(T.alpha_tokens(F.col(side))).alias("word")).filter(~F.col("word").isin(*stop)).groupBy("register", "condition", "word").agg(F.count(F.lit(1)).alias("n"))
    return S.first_k(c, ["register", "condition"], [F.desc("n"), F.col("word")], n)


def _top_sql(side: str, n: int = 50) -> str:
    return f"(SELECT register, condition, w AS word, n FROM (SELECT *, row_number() OVER (PARTITION BY register, condition ORDER BY n DESC, w) AS r FROM {_freq_sql(side)}) WHERE r <= {n})"


@query(f"SELECT coalesce(h.register, a.register) AS register, coalesce(h.condition, a.condition) AS condition, coalesce(h.word, a.word) AS word, coalesce(h.n, 0) AS human_count, coalesce(a.n, 0) AS ai_count, coalesce(h.n, 0) - coalesce(a.n, 0) AS diff FROM {_top_sql('human')} h FULL JOIN {_top_sql('llm')} a ON h.register = a.register AND h.condition = a.condition AND h.word = a.word")
def word_freq_compare(spark: SparkSession, d: str) -> DataFrame:
    h, a = _top_words(spark, d, "human").withColumnRenamed("n", "h"), _top_words(spark, d, "llm").withColumnRenamed("n", "a")
    j = h.join(a, ["register", "condition", "word"], "full_outer").na.fill(0, ["h", "a"])
    return j.select("register", "condition", "word", F.col("h").alias("human_count"), F.col("a").alias("ai_count"), (F.col("h") - F.col("a")).alias("diff"))


@query(
    f"""SELECT register, condition, CASE WHEN h AND a THEN 'shared' WHEN h THEN 'human' ELSE 'ai' END AS part, CAST(count(*) AS BIGINT) AS n FROM (SELECT register, condition, word, bool_or(s = 'h') AS h, bool_or(s = 'a') AS a FROM (SELECT register, condition, word, 'h' AS s FROM {_top_sql('human')} UNION ALL SELECT register, condition, word, 'a' FROM {_top_sql('llm')}) GROUP BY ALL) GROUP BY ALL"""
)
def vocab_venn(spark: SparkSession, d: str) -> DataFrame:
    both = _top_words(spark, d, "human").withColumn("s", F.lit("h")).unionByName(_top_words(spark, d, "llm").withColumn("s", F.lit("a")))
    w = both.groupBy("register", "condition", "word").agg(F.max((F.col("s") == "h").cast("int")).alias("h"), F.max((F.col("s") == "a").cast("int")).alias("a"))
    return w.groupBy("register", "condition", F.when(F.col("h") + F.col("a") == 2, "shared").when(F.col("h") == 1, "human").otherwise("ai").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r AS id FROM (SELECT DISTINCT source_row AS r FROM quiz_master_balanced WHERE register = 'formal' UNION SELECT source_row FROM embedding_pair_cosine_formal_human_like) WHERE r IS NOT NULL")
def id_union(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "quiz_master_balanced").filter("register = 'formal'").select(F.col("source_row").alias("id"))
    return q.union(table(spark, d, "embedding_pair_cosine_formal_human_like").select("source_row")).filter("id IS NOT NULL").distinct()


@query("SELECT round(avg(CASE WHEN n > 0 THEN 1 ELSE 0 END), 6) AS overlap, CAST(count(*) AS BIGINT) AS rows FROM (SELECT s.row_id, (SELECT count(*) FROM embedding_pair_cosine_formal_human_like e WHERE e.Title = s.Title) AS n FROM sv_abstracts_adversarial s)")
def overlap_rate(spark: SparkSession, d: str) -> DataFrame:
    titles = table(spark, d, "embedding_pair_cosine_formal_human_like").select("Title", F.lit(1).alias("hit")).distinct()
    s = table(spark, d, "sv_abstracts_adversarial").join(titles, "Title", "left")
    return s.agg(r6(F.avg(F.coalesce("hit", F.lit(0))), "overlap"), F.count(F.lit(1)).alias("rows"))


@query("SELECT item_id, rank FROM (SELECT item_id, register, CAST(row_number() OVER (PARTITION BY register ORDER BY md5('7|' || item_id), item_id) AS BIGINT) AS rank FROM quiz_master_balanced)")
def seeded_order(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "quiz_master_balanced").select("item_id", "register")
    return S.seeded_rank(q, ["register"], 7, "item_id").select("item_id", (F.col("_before") + 1).cast("bigint").alias("rank"))


@query(
    """WITH p AS (SELECT * FROM sv_abstracts_adversarial ORDER BY md5('3|' || row_id), row_id LIMIT 20), v AS (SELECT row_id, Title AS context, unnest(['human', 'baseline', 'human_like', 'detector_evasive']) AS condition, unnest([Abstract, Abstract_baseline, Abstract_human_like, Abstract_detector_evasive]) AS text FROM p)
SELECT 'formal' AS register, row_id AS source_row, 'formal-' || row_id AS pair_id, context, condition, condition = 'human' AS is_human, text, CAST(row_number() OVER (ORDER BY md5('3|' || row_id || '|' || condition)) AS BIGINT) AS item_id FROM v"""
)
def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    items = S.balanced_items(table(spark, d, "sv_abstracts_adversarial"), "formal", "Title", "Abstract", {c: "Abstract_" + c for c in P.REPORTED}, 20, 3)
    return items.withColumn("item_id", F.col("item_id").cast("bigint"))


@query("SELECT row_id, ['a', 'b', 'c'][CAST(floor((r - 1) / 10) AS INT) + 1] AS role FROM (SELECT row_id, row_number() OVER (ORDER BY md5('5|' || row_id), row_id) AS r FROM sv_abstracts_adversarial) WHERE r <= 30")
def role_assignment(spark: SparkSession, d: str) -> DataFrame:
    return S.assign_roles(table(spark, d, "sv_abstracts_adversarial").select("row_id"), "row_id", ["a", "b", "c"], 10, 5)


_BANDED = {"human": "human_comment", **{c: "comment_" + c for c in P.REPORTED}}


def _assignment_sql() -> str:
    fits = " UNION ALL ".join(f"SELECT thread_id, row_id, {i} AS role FROM {P.INFORMAL[1]} WHERE thread_id IS NOT NULL AND coalesce(length({c}) BETWEEN 40 AND 600, false)" for i, c in enumerate(_BANDED.values()))
    steps, k = [], len(_BANDED)
    for t in range(1, k + 1):
        before = " AND ".join(f"f.row_id <> coalesce(s{u}.row_id, -1)" for u in range(1, t)) or "true"
        joins = " ".join(f"LEFT JOIN s{u} ON s{u}.thread_id = f.thread_id" for u in range(1, t))
        steps.append(f"s{t} AS (SELECT f.thread_id, f.role, arg_min(f.row_id, md5('9|' || f.row_id)) AS row_id FROM f JOIN o ON o.thread_id = f.thread_id AND o.role = f.role AND o.turn = {t} {joins} WHERE {before} GROUP BY ALL)")
    names = "[" + ", ".join(f"'{n}'" for n in _BANDED) + "]"
    whole = " ".join(f"JOIN s{u} USING (thread_id)" for u in range(2, k + 1))
    pairs = " UNION ALL ".join(f"SELECT thread_id, row_id, role FROM s{u}" for u in range(1, k + 1))
    return f"""WITH f AS ({fits}), n AS (SELECT thread_id, role, count(*) AS n FROM f GROUP BY ALL), o AS (SELECT thread_id, role, row_number() OVER (PARTITION BY thread_id ORDER BY n, role) AS turn FROM n WHERE thread_id IN (SELECT thread_id FROM n GROUP BY thread_id HAVING count(*) = {k})),
 {', '.join(steps)}, w AS (SELECT thread_id FROM s1 {whole}) SELECT thread_id, row_id, {names}[role + 1] AS role FROM ({pairs}) JOIN w USING (thread_id)"""


@query(_assignment_sql())
def thread_assignment(spark: SparkSession, d: str) -> DataFrame:
    """In each thread one reply for each version, of which the text shown is of the right length; the scarcest versions choose first."""
    t = table(spark, d, P.INFORMAL[1]).filter("thread_id IS NOT NULL")
    return S.assign_threads(t, "thread_id", "row_id", {k: F.length(c).between(40, 600) for k, c in _BANDED.items()}, 9)


@query("SELECT s.pair_id, min(e.row_id) AS row_id FROM embedding_pair_cosine_formal_human_like e JOIN (SELECT row_id, Title FROM embedding_pair_cosine_formal_human_like) t ON e.row_id = t.row_id JOIN (SELECT DISTINCT context, pair_id FROM quiz_master_balanced) s ON s.context = t.Title GROUP BY s.pair_id")
def chained_lookup(spark: SparkSession, d: str) -> DataFrame:
    """From scored rows to their titles, to the quiz items with that title, to the items' documents."""
    e = table(spark, d, "embedding_pair_cosine_formal_human_like")
    q = table(spark, d, "quiz_master_balanced").select(F.col("context").alias("Title"), "pair_id")
    return P.chained_lookup(e.select("row_id"), e.select("row_id", "Title"), q, "row_id", "Title", "pair_id")


@query("SELECT row_id, feature, human, llm FROM (SELECT row_id, unnest(['chars', 'lines']) AS feature, unnest([CAST(length(Abstract) AS DOUBLE), CAST(length(Abstract) - length(replace(Abstract, chr(10), '')) AS DOUBLE)]) AS human, unnest([CAST(length(Abstract_baseline) AS DOUBLE), CAST(length(Abstract_baseline) - length(replace(Abstract_baseline, chr(10), '')) AS DOUBLE)]) AS llm FROM sv_abstracts_adversarial)")
def twin_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns that have a twin under the other prefix, found by name; those without one are left out."""
    c = {"human_": F.col("Abstract"), "llm_": F.col("Abstract_baseline")}
    wide = [f.alias(side + n) for side, t in c.items() for n, f in (("chars", F.length(t)), ("lines", T.literal_count(t, "\n")))]
    t = table(spark, d, P.FORMAL[1]).select("row_id", *wide, F.lit(1).alias("human_only"), F.lit(2).alias("llm_alone"))
    return X.twin_pairs(t, ["row_id"])


@query("WITH c AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL), t AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang) SELECT source, lang, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total, CAST(dense_rank() OVER (ORDER BY total DESC, lang) AS INT) AS place FROM c JOIN t USING (lang)")
def entity_order(spark: SparkSession, d: str) -> DataFrame:
    """Counts per group and label, the labels in the order of their totals over all groups."""
    c = docs(spark, d).filter("lang IS NOT NULL AND source IS NOT NULL").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    t = c.groupBy("lang").agg(F.sum("n").alias("total"))
    placed = t.withColumn("place", F.dense_rank().over(Window.orderBy(F.desc("total"), "lang")))  # as many rows as labels
    return c.join(placed, "lang").select("source", "lang", "n", "total", "place")


@query("SELECT DISTINCT condition AS name, 'used' AS found FROM quiz_master_balanced WHERE condition IS NOT NULL AND condition NOT IN ('human', 'baseline', 'human_like') UNION ALL SELECT * FROM (VALUES ('human', 'listed'), ('baseline', 'listed'), ('human_like', 'listed'), ('rewritten', 'listed')) l(name, found) WHERE name NOT IN (SELECT condition FROM quiz_master_balanced WHERE condition IS NOT NULL)")
def undocumented(spark: SparkSession, d: str) -> DataFrame:
    """Conditions that are used but not in the list, and listed ones that are not used."""
    used = table(spark, d, "quiz_master_balanced").filter("condition IS NOT NULL").select(F.col("condition").alias("name")).distinct()
    listed = spark.createDataFrame([("human",), ("baseline",), ("human_like",), ("rewritten",)], "name string")
    return used.join(listed, "name", "left_anti").withColumn("found", F.lit("used")).unionByName(listed.join(used, "name", "left_anti").withColumn("found", F.lit("listed")))


# --- statistics ---------------------------------------------------------------------------------------------------------------


def paired_features(spark: SparkSession, d: str, conditions=P.REPORTED) -> DataFrame:
    """(register, condition, feature, row_id, human, llm): word count, type-token ratio, mean word length and marks of complete pairs."""
    pairs = P.complete(corpora(spark, d, conditions)).select("register", "condition", "row_id", *[F.struct(F.col(c).alias("t"), T.alpha_tokens(F.col(c)).alias("w")).alias(c) for c in ("human", "llm")])

    def side(c):
        w, t = F.col(c + ".w"), F.col(c + ".t")
        chars = F.length(F.array_join(w, "")).cast("double")
        return [F.size(w).cast("double"), F.round(X.ttr(w), 9), F.round(T.ratio(chars, F.size(w)), 9), T.literal_count(t, ",").cast("double"), T.literal_count(t, ".").cast("double")]

    names = ("n_words", "ttr", "word_length", "commas", "periods")
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), h.alias("human"), m.alias("llm")) for n, h, m in zip(names, side("human"), side("llm"))])
    return pairs.select("register", "condition", "row_id", F.explode(rows).alias("f")).select("register", "condition", "row_id", "f.*")


def _features_sql(conditions=P.REPORTED) -> str:
    def side(c):
        w = ALPHA.format(c)
        return [f"CAST(len({w}) AS DOUBLE)", f"round(CASE WHEN len({w}) > 0 THEN len(list_distinct({w})) / len({w}) ELSE 0.0 END, 9)", f"round(CASE WHEN len({w}) > 0 THEN list_sum(list_transform({w}, lambda x: length(x))) / len({w}) ELSE 0.0 END, 9)", f"CAST(length({c}) - length(replace({c}, ',', '')) AS DOUBLE)", f"CAST(length({c}) - length(replace({c}, '.', '')) AS DOUBLE)"]

    return f"(SELECT register, condition, row_id, unnest(['n_words', 'ttr', 'word_length', 'commas', 'periods']) AS feature, unnest([{', '.join(side('human'))}]) AS human, unnest([{', '.join(side('llm'))}]) AS llm FROM ({_long_sql(conditions)}) WHERE {NONEMPTY.format('human')} AND {NONEMPTY.format('llm')})"


_TESTS = """d AS (SELECT {k}, human, llm, round(llm - human, 12) AS d FROM {src}),
b AS (SELECT {k}, count(*) AS n_pairs, median(human) AS mh, median(llm) AS ml, avg(d) AS m, stddev_samp(d) AS s FROM d GROUP BY {k}),
r AS (SELECT {k}, d, rank() OVER (PARTITION BY {k} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {k}, abs(d)) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY {k}, abs(d)) AS t FROM d WHERE d <> 0),
w AS (SELECT {k}, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS up, sum(CASE WHEN d < 0 THEN rk ELSE 0 END) AS down, count(*) AS n, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r GROUP BY {k}),
z AS (SELECT {k}, n_pairs, mh, ml, CASE WHEN n IS NULL THEN 0.0 WHEN s > 0 THEN m / s END AS dz, coalesce((up - down) / (up + down), 0.0) AS rb, coalesce(least(up, down), 0.0) AS stat,
 abs((least(up, down) - n * (n + 1.0) / 4) / sqrt(n * (n + 1.0) * (2.0 * n + 1) / 24 - ties / 48)) / sqrt(2.0) AS x, n, ties FROM b LEFT JOIN w USING ({k}) WHERE n_pairs >= 3),
subsets AS (SELECT * FROM (WITH RECURSIVE c(k, l) AS (SELECT 0, [CAST(1 AS DOUBLE)] UNION ALL SELECT k + 1, list_transform(range(0, len(l) + k + 1), lambda s: coalesce(l[s + 1], 0) + CASE WHEN s > k THEN coalesce(l[s - k], 0) ELSE 0 END) FROM c WHERE k < 50) SELECT * FROM c)),
p AS (SELECT z.*, CASE WHEN x IS NULL THEN 1.0 WHEN n <= 50 AND ties = 0 AND n = n_pairs THEN least(1.0, 2 * list_sum(l[1:CAST(stat AS INT) + 1]) / pow(2.0, n)) ELSE (1 / (1 + 0.3275911 * x)) * (0.254829592 + (1 / (1 + 0.3275911 * x)) * (-0.284496736 + (1 / (1 + 0.3275911 * x)) * (1.421413741 + (1 / (1 + 0.3275911 * x)) * (-1.453152027 + (1 / (1 + 0.3275911 * x)) * 1.061405429)))) * exp(-x * x) END AS pv FROM z LEFT JOIN subsets ON subsets.k = z.n),
q AS (SELECT *, pv * count(*) OVER (PARTITION BY {f}) / (rank() OVER (PARTITION BY {f} ORDER BY pv) + count(*) OVER (PARTITION BY {f}, pv) - 1) AS raw FROM p),
e AS (SELECT *, least(1.0, min(raw) OVER (PARTITION BY {f} ORDER BY pv RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS fdr FROM q)"""
_EFFECT_COLUMNS = "CAST(n_pairs AS BIGINT) AS n_pairs, round(mh, 6) AS median_human, round(ml, 6) AS median_llm, CASE WHEN ml > mh THEN 'llm > human' WHEN ml < mh THEN 'llm < human' ELSE 'equal' END AS direction, round(dz, 6) AS cohens_dz, round(rb, 6) AS rank_biserial, round(stat, 1) AS wilcoxon_stat, round(pv, 6) AS p_value, round(fdr, 6) AS p_fdr_bh, fdr < 0.05 AS significant"


def _rounded(tests: DataFrame, keys: list[str]) -> DataFrame:
    return tests.select(*keys, "n_pairs", r6(F.col("median_human"), "median_human"), r6(F.col("median_llm"), "median_llm"), "direction", r6(F.col("cohens_dz"), "cohens_dz"), r6(F.col("rank_biserial"), "rank_biserial"), F.round("wilcoxon_stat", 1).alias("wilcoxon_stat"), r6(F.col("p_value"), "p_value"), r6(F.col("p_fdr_bh"), "p_fdr_bh"), "significant")


@query("WITH " + _TESTS.format(k="register, condition, feature", f="register, condition", src=_features_sql()) + f" SELECT register, condition, feature, {_EFFECT_COLUMNS} FROM e")
def paired_effects(spark: SparkSession, d: str) -> DataFrame:
    keys = ["register", "condition", "feature"]
    return _rounded(A.fdr(A.paired_tests(paired_features(spark, d), keys, exact_p=False), ["register", "condition"]), keys)


def _mtld_sql(w: str) -> str:
    """Factors of a word list by a fold over it, forwards and backwards."""

    def factors(words: str) -> str:
        seen = "CASE WHEN list_contains(a.seen, x.w) THEN a.seen ELSE list_append(a.seen, x.w) END"
        state = "{{'w': {0}, 'seen': {1}, 'n': {2}, 'f': {3}}}".format
        fold = f"list_reduce(list_transform({words}, lambda y: {state('y', 'CAST([] AS VARCHAR[])', '0', '0')}), lambda a, x: CASE WHEN len({seen}) <= {X.MTLD_LIMIT} * (a.n + 1) THEN {state(repr(''), 'CAST([] AS VARCHAR[])', '0', 'a.f + 1')} ELSE {state(repr(''), seen, 'a.n + 1', 'a.f')} END, {state(repr(''), 'CAST([] AS VARCHAR[])', '0', '0')})"
        return f"(SELECT r.f + CASE WHEN r.n > 0 THEN (1 - len(r.seen) / r.n) / {1 - X.MTLD_LIMIT!r} ELSE 0 END FROM (SELECT {fold} AS r))"

    one = lambda words: f"len({w}) / coalesce(nullif({factors(words)}, 0), 1.0)"
    return f"CASE WHEN len({w}) >= 10 THEN ({one(w)} + {one(f'list_reverse({w})')}) / 2 END"


def _native_sql(names: bool = False) -> str:
    """Expressions of the native features over t, w (words), s (surface words), q (sentences) and n (tokens), in a list, or their names."""
    grams = lambda k: f"CASE WHEN len(s) >= {k} THEN list_transform(range(1, len(s) - {k - 2}), lambda i: array_to_string(s[i:i + {k - 1}], ' ')) ELSE [] END"
    again = lambda k: f"CASE WHEN len(s) >= {k} THEN (len(s) - {k - 1} - len(list_distinct({grams(k)}))) / (len(s) - {k - 1}) ELSE 0.0 END"
    share = lambda a, b, k=1: f"CASE WHEN {b} > 0 THEN ({a}) * {float(k)} / {b} ELSE 0.0 END"
    found = {
        "n_alpha_tokens": "len(w)", "ttr": share("len(list_distinct(w))", "len(w)"),
        "mattr": "CASE WHEN len(w) = 0 THEN 0.0 WHEN len(w) < 100 THEN len(list_distinct(w)) / len(w) ELSE list_sum(list_transform(range(1, len(w) - 98), lambda i: len(list_distinct(w[i:i + 99])))) / (len(w) - 99) / 100 END",
        "mtld": _mtld_sql("w"), "bigram_repetition_rate": again(2), "trigram_repetition_rate": again(3), "function_word_rate": share(f"len(list_filter(w, lambda x: list_contains({sorted(set(FUNCTION_WORDS))}, x)))", "len(w)"),
        "n_sentences": "len(q)", "negation_sentence_rate": share(f"len(list_filter(q, lambda x: regexp_matches(lower(x), '{_NEGATED}')))", "len(q)"),
    } | {f"punct_{k}": share(" + ".join(f"(length(t) - length(replace(t, '{m}', ''))) / {len(m)}" for m in marks), "n", 100) for k, marks in X.MARKS.items()}
    hits = {k: f"len(regexp_extract_all(' ' || array_to_string(w, '  ') || ' ', '{X.phrase_pattern(lex)}'))" for k, lex in CATEGORIES.items()}
    found |= {f"{k}_rate": share(h, "len(w)", 100) for k, h in hits.items()} | {f"{k}_count": h for k, h in hits.items()}
    return "[" + ", ".join(f"'{k}'" for k in found) + "]" if names else "[" + ", ".join(f"round(CAST({v} AS DOUBLE), 9)" for v in found.values()) + "]"


_INFORMAL_ONLY = (*[f"punct_{m}" for m in X.INFORMAL_MARKS], *[f"{k}_{x}" for k in CATEGORIES if k not in X.FORMAL_CATEGORIES for x in ("rate", "count")])


def _native_pairs_sql(sides: str, left: str) -> str:
    """sides: (register, row_id, side, t)."""
    return f"""f AS (SELECT register, row_id, side, unnest({_native_sql(True)}) AS feature, unnest({_native_sql()}) AS v FROM (SELECT *, {ALPHA.format('t')} AS w, {SURFACE.format('t')} AS s, {_sentences_sql('t')} AS q, {TOKENS.format('t')} AS n FROM ({sides}) WHERE {NONEMPTY.format('t')})),
 x AS (SELECT h.register, l.side AS condition, h.feature, h.row_id, h.v AS human, l.v AS llm FROM f h JOIN f l ON h.register = l.register AND h.row_id = l.row_id AND h.feature = l.feature AND h.side = '{left}' AND l.side <> '{left}' WHERE h.v IS NOT NULL AND l.v IS NOT NULL AND (h.register = 'informal' OR h.feature NOT IN {_INFORMAL_ONLY}))"""


def _versions(spark, d, registers: dict) -> list[tuple[str, DataFrame]]:
    """Per register (register, row_id, side, text): one row for each of the named versions that has a text."""
    out = []
    for register, (name, columns) in registers.items():
        sides = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(c).alias("t")) for k, c in columns.items()]))
        t = spread(table(spark, d, name), "row_id").select(F.lit(register).alias("register"), "row_id", sides.alias("s")).select("register", "row_id", "s.side", "s.t")
        out.append((register, t.filter(T.non_empty(F.col("t")))))
    return out


def _version_sql(registers: dict) -> str:
    return " UNION ALL ".join(f"SELECT '{r}' AS register, row_id, '{k}' AS side, {c} AS t FROM {name}" for r, (name, columns) in registers.items() for k, c in columns.items())


_PAIRED = {reg: (name, {"human": human} | {c: prefix + c for c in P.REPORTED}) for reg, name, _, human, prefix in (P.FORMAL, P.INFORMAL)}
_GENERATORS = {"informal": (P.INFORMAL[1], {"other": "generated_comment"} | {c: "comment_" + c for c in P.REPORTED})}


def native_pairs(spark: SparkSession, d: str, registers: dict, left: str) -> DataFrame:
    """(register, row_id, condition, feature, human, llm) of every native feature of the register."""
    parts = [X.side_features(t, ["register", "row_id"], "side", left, "t", register) for register, t in _versions(spark, d, registers)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("WITH " + _native_pairs_sql(_version_sql(_PAIRED), "human") + ", " + _TESTS.format(k="register, condition, feature", f="register, condition", src="x") + f" SELECT register, condition, feature, {_EFFECT_COLUMNS} FROM e")
def paired_effects_full(spark: SparkSession, d: str) -> DataFrame:
    """Every native feature, marker family and mark of both registers, with one family of tests per register and condition."""
    keys = ["register", "condition", "feature"]
    return _rounded(A.fdr(A.paired_tests(native_pairs(spark, d, _PAIRED, "human"), keys, exact_p=False), ["register", "condition"]), keys)


def _group_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN starts_with({c}, '{start}') THEN '{group}'" for start, group in X.GROUPS) + " ELSE 'pragmatic' END"


@query("WITH " + _native_pairs_sql(_version_sql(_GENERATORS), "other") + ", " + _TESTS.format(k="register, condition, feature", f="register, condition", src="x") + f" SELECT register, condition, 'other vs ' || condition AS comparison, {_group_sql('feature')} AS feature_group, feature, {_EFFECT_COLUMNS} FROM e")
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Two generators' texts for the same document against each other, in six groups of features; one family per register, condition and comparison."""
    keys = ["register", "condition", "feature"]
    t = _rounded(A.fdr(A.paired_tests(native_pairs(spark, d, _GENERATORS, "other"), keys, exact_p=False), ["register", "condition"]), keys)
    return t.select("register", "condition", F.concat(F.lit("other vs "), "condition").alias("comparison"), X.group_of(F.col("feature")).alias("feature_group"), *t.columns[2:])


_AFFECTIVE = ("booster_rate", "negation_rate", "hedge_rate")


@query(
    "WITH " + _native_pairs_sql(_version_sql(_PAIRED), "human").replace("x AS (", "every AS (") + f", x AS (SELECT *, 'human vs machine' AS comparison FROM every WHERE feature IN {_AFFECTIVE}), "
    + _TESTS.format(k="comparison, register, condition, feature", f="comparison", src="x") + f" SELECT comparison, register, condition, feature, {_EFFECT_COLUMNS} FROM e"
)
def affective_effects(spark: SparkSession, d: str) -> DataFrame:
    """Marker families of attitude, as a stand-in for a sentiment model, with one family of tests over all registers and conditions of the comparison."""
    keys = ["comparison", "register", "condition", "feature"]
    x = native_pairs(spark, d, _PAIRED, "human").filter(F.col("feature").isin(*_AFFECTIVE)).withColumn("comparison", F.lit("human vs machine"))
    return _rounded(A.fdr(A.paired_tests(x, keys, exact_p=False), ["comparison"]), keys)


@query("WITH " + _TESTS.format(k="feature, l_returnflag, l_linestatus", f="feature", src="(SELECT unnest(['price', 'tax']) AS feature, l_returnflag, l_linestatus, l_quantity AS human, unnest([l_extendedprice / 1000, l_tax * 500]) AS llm FROM lineitem)") + f" SELECT feature, l_returnflag, l_linestatus, {_EFFECT_COLUMNS} FROM e")
def paired_effects_large(spark: SparkSession, d: str) -> DataFrame:
    quantity = F.col("l_quantity")
    pairs = {"price": (quantity, F.col("l_extendedprice") / 1000), "tax": (quantity, F.col("l_tax") * 500)}
    t = A.paired_tests_wide(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], pairs, exact_p=False)
    return _rounded(A.fdr(t, ["feature"]), ["feature", "l_returnflag", "l_linestatus"])


@query("WITH " + _TESTS.format(k="l_orderkey", f="l_orderkey", src="(SELECT l_orderkey, l_quantity AS human, l_extendedprice / 1000 AS llm FROM lineitem)") + f" SELECT l_orderkey, {_EFFECT_COLUMNS} FROM e")
def paired_effects_small(spark: SparkSession, d: str) -> DataFrame:
    """Many small samples with exact p-values; each order is a family of its own, so that no family grows with the data."""
    t = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("human"), (F.col("l_extendedprice") / 1000).alias("llm"))
    return _rounded(A.fdr(A.paired_tests(t, ["l_orderkey"], exact_p=False), ["l_orderkey"]), ["l_orderkey"])


@query(
    "WITH f AS " + _features_sql(("baseline", "human_like")) + ", x AS (SELECT a.register, 'baseline vs human_like' AS comparison, a.feature, a.row_id, a.llm AS human, b.llm AS llm FROM f a JOIN f b ON a.register = b.register AND a.feature = b.feature AND a.row_id = b.row_id AND a.condition = 'baseline' AND b.condition = 'human_like'), "
    + _TESTS.format(k="register, comparison, feature", f="comparison", src="x") + f" SELECT register, comparison, feature, {_EFFECT_COLUMNS} FROM e"
)
def version_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Machine versions against each other; one family per comparison."""
    long = paired_features(spark, d, ("baseline", "human_like"))
    pairs = P.generator_pairs(long, ["register", "feature", "row_id"], "condition", "llm")
    x = pairs.select("register", F.concat_ws(" vs ", "name_a", "name_b").alias("comparison"), "feature", F.col("value_a").alias("human"), F.col("value_b").alias("llm"))
    keys = ["register", "comparison", "feature"]
    return _rounded(A.fdr(A.paired_tests(x, keys, exact_p=False), ["comparison"]), keys)


@query(C.effect_summary(_TESTS.format(k="register, condition, feature", f="register, condition", src=_features_sql())))
def effect_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per register and feature: packed effects, common direction, largest band and k of n significant conditions."""
    keys = ["register", "condition", "feature"]
    t = A.fdr(A.paired_tests(paired_features(spark, d), keys), ["register", "condition"])
    t = t.withColumn("shown", F.format_string("%s %+.2f%s", F.col("condition"), F.round("cohens_dz", 2), A.stars(F.col("p_fdr_bh"))))
    g = t.groupBy("register", "feature").agg(F.array_join(F.array_sort(F.collect_list("shown")), "; ").alias("effects"), F.max(F.abs("cohens_dz")).alias("m"), F.median(F.abs("cohens_dz")).alias("md"), F.count_if("significant").alias("n_significant"), F.count(F.lit(1)).alias("n_tests"), F.min("direction").alias("lo"), F.max("direction").alias("hi"))
    return g.select("register", "feature", "effects", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("mixed").alias("direction"), A.effect_band(F.col("m")).alias("band"), r6(F.col("m"), "max_effect"), r6(F.col("md"), "median_effect"), "n_significant", "n_tests")


@query(C.normalisation_delta(_long_sql(P.REPORTED), NONEMPTY, ALPHA, _TESTS.format(k="condition, version", f="condition, version", src="x")))
def normalisation_delta(spark: SparkSession, d: str) -> DataFrame:
    """Effects before and after the informal normaliser, and what changed."""
    raw = P.complete(corpora(spark, d, P.REPORTED).filter("register = 'informal'"))
    clean = raw.withColumn("human", T.normalize_informal(F.col("human"))).withColumn("llm", T.normalize_informal(F.col("llm")))
    both = raw.withColumn("version", F.lit("pre")).unionByName(clean.withColumn("version", F.lit("post")))
    count = lambda c: F.size(T.alpha_tokens(F.col(c))).cast("double")
    t = A.paired_tests(both.select("condition", "version", count("human").alias("human"), count("llm").alias("llm")), ["condition", "version"])
    p = t.groupBy("condition").pivot("version", ["pre", "post"]).agg(F.first("cohens_dz").alias("dz"), F.first("median_human").alias("mh"), F.first("n_pairs").alias("n"), F.first("p_value").alias("p"))
    change = F.col("post_dz") - F.col("pre_dz")
    pct = 100 * (F.col("post_mh") - F.col("pre_mh")) / F.nullif(F.col("pre_mh"), F.lit(0.0))
    return p.select("condition", r6(F.col("pre_dz"), "dz_pre"), r6(F.col("post_dz"), "dz_post"), r6(change, "dz_change"), r6(pct, "human_change_pct"), F.col("pre_n").alias("n_pre"), F.col("post_n").alias("n_post"), ((F.abs(change) >= 0.01) | (F.abs(pct) >= 0.5)).alias("moved"))


_SIDES = f"(SELECT register, condition, 'human' AS side, human AS t FROM ({_long_sql(P.REPORTED)}) UNION ALL SELECT register, condition, 'llm', llm FROM ({_long_sql(P.REPORTED)}))"


@query(
    f"""WITH c AS (SELECT register, condition, label, sum(CASE WHEN side = 'human' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN side = 'llm' THEN 1 ELSE 0 END) AS b FROM (SELECT register, condition, side, least(length(unnest({ALPHA.format('t')})), 15) AS label FROM {_SIDES}) GROUP BY ALL),
 s AS (SELECT *, a / sum(a) OVER (PARTITION BY register, condition) AS p, b / sum(b) OVER (PARTITION BY register, condition) AS q FROM c)
 SELECT register, condition, CAST(sum(a) AS BIGINT) AS human_total, CAST(sum(b) AS BIGINT) AS llm_total, round(sum(0.5 * CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + 0.5 * CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END), 6) AS js_divergence,
 round(sqrt(sum(0.5 * CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + 0.5 * CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)), 6) AS js_distance FROM s GROUP BY register, condition"""
)
def js_distance(spark: SparkSession, d: str) -> DataFrame:
    """Word-length distributions of the two sides."""
    long = corpora(spark, d, P.REPORTED)
    sides = F.explode(F.array(F.struct(F.lit("human").alias("side"), F.col("human").alias("t")), F.struct(F.lit("llm").alias("side"), F.col("llm").alias("t"))))
    w = long.select("register", "condition", sides.alias("s")).select("register", "condition", "s.side", F.explode(T.alpha_tokens(F.col("s.t"))).alias("w"))
    counts = w.groupBy("register", "condition", "side", F.least(F.length("w"), F.lit(15)).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    j = A.jensen_shannon(counts, ["register", "condition"], "label")
    return j.select("register", "condition", "human_total", "llm_total", r6(F.col("js_divergence"), "js_divergence"), r6(F.col("js_distance"), "js_distance"))


def _label_sql() -> str:
    tokens = "regexp_extract_all(s, '\\p{L}+|\\p{N}+|[^\\s\\p{L}\\p{N}]')"
    named = "(regexp_matches(text, '^\\p{Lu}\\p{L}*$') AND i > 0)"
    tag = f"CASE WHEN {named} THEN 'PROPN' WHEN regexp_matches(text, '^\\p{{L}}+$') THEN 'NOUN' WHEN regexp_matches(text, '^\\p{{N}}+$') THEN 'NUM' ELSE 'PUNCT' END"
    dep = "CASE WHEN i = 0 THEN 'ROOT' WHEN lower(text) IN ('som', 'att') THEN 'acl:relcl' ELSE 'dep' END"
    js = "0.5 * CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + 0.5 * CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END"
    return f"""WITH v AS (SELECT register, side AS version, t FROM ({_version_sql(_PAIRED)}) WHERE {NONEMPTY.format('t')}), s AS (SELECT register, version, unnest(string_split(regexp_replace(trim(t), '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31))) AS s FROM v),
 k AS (SELECT register, version, unnest({tokens}) AS text, unnest(range(0, len({tokens}))) AS i FROM s), l AS (SELECT register, version, 'dep' AS kind, {dep} AS label FROM k UNION ALL SELECT register, version, 'pos', {tag} FROM k UNION ALL SELECT register, version, 'ent', CASE WHEN {named} THEN 'LOC' ELSE 'none' END FROM k),
 c AS (SELECT register, version, kind, label, count(*) AS n FROM l GROUP BY ALL), x AS (SELECT h.register, v.version AS condition, h.kind, h.label, h.n AS a, 0 AS b FROM c h JOIN (SELECT DISTINCT register, version FROM c WHERE version <> 'human') v ON h.register = v.register AND h.version = 'human' UNION ALL SELECT register, version, kind, label, 0, n FROM c WHERE version <> 'human'),
 t AS (SELECT register, condition, kind, label, sum(a) AS a, sum(b) AS b FROM x GROUP BY ALL), p AS (SELECT *, a / sum(a) OVER w AS p, b / sum(b) OVER w AS q FROM t WINDOW w AS (PARTITION BY register, condition, kind))
 SELECT register, condition, kind, CAST(sum(a) AS BIGINT) AS human_total, CAST(sum(b) AS BIGINT) AS llm_total, round(sum({js}), 6) AS js_divergence, round(sqrt(sum({js})), 6) AS js_distance FROM p GROUP BY register, condition, kind"""


def label_distances(annotation: DataFrame, versions: DataFrame) -> DataFrame:
    """Jensen-Shannon distances of the relation, tag and entity labels of the human side and each other version.

    annotation: any parser's table, with doc_id; versions: (doc_id, register, version). Tokens without entity count as none. The counts of labels are few, so each version meets them in a small join.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("label")) for k, c in (("dep", F.col("dep")), ("pos", F.col("pos")), ("ent", F.coalesce("ent", F.lit("none"))))])
    counts = cut(annotation.join(versions, "doc_id").select("register", "version", F.explode(kinds).alias("k")).groupBy("register", "version", "k.kind", "k.label").agg(F.count(F.lit(1)).alias("n")))
    others = counts.filter("version <> 'human'").select("register", F.col("version").alias("condition")).distinct()
    human = counts.filter("version = 'human'").join(others, "register").select("register", "condition", "kind", "label", "n", F.lit("human").alias("side"))
    both = human.unionByName(counts.filter("version <> 'human'").select("register", F.col("version").alias("condition"), "kind", "label", "n", F.lit("llm").alias("side")))
    return A.jensen_shannon(both, ["register", "condition", "kind"], "label")


@query(_label_sql())
def js_labels(spark: SparkSession, d: str) -> DataFrame:
    parts = [t for _, t in _versions(spark, d, _PAIRED)]
    texts = parts[0].unionByName(parts[1]).withColumn("doc_id", F.concat_ws("|", "register", F.col("row_id").cast("string"), "side"))
    j = label_distances(N.from_tokens(texts, "doc_id", "t"), texts.select("doc_id", "register", F.col("side").alias("version")))
    return j.select("register", "condition", "kind", "human_total", "llm_total", r6(F.col("js_divergence"), "js_divergence"), r6(F.col("js_distance"), "js_distance"))


@query(
    """WITH v AS (SELECT l_returnflag, CASE WHEN l_linestatus = 'O' THEN 'human' ELSE 'llm' END AS side, CAST(l_quantity AS DOUBLE) AS v FROM lineitem), c AS (SELECT l_returnflag, v, count(*) FILTER (side = 'human') AS a, count(*) FILTER (side = 'llm') AS b FROM v GROUP BY ALL),
 s AS (SELECT l_returnflag, lead(v) OVER w - v AS gap, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY l_returnflag) - sum(b) OVER w / sum(b) OVER (PARTITION BY l_returnflag)) AS diff FROM c WINDOW w AS (PARTITION BY l_returnflag ORDER BY v)) SELECT l_returnflag, round(coalesce(sum(gap * diff), 0.0), 6) AS wasserstein FROM s GROUP BY l_returnflag"""
)
def wasserstein(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_linestatus") == "O", "human").otherwise("llm").alias("side"), F.col("l_quantity").alias("value"))
    return A.wasserstein(t, ["l_returnflag"]).select("l_returnflag", r6(F.col("wasserstein"), "wasserstein"))


@query("SELECT label % 2 AS side, round(min(c), 6) AS low, round(avg(c), 6) AS mean, round(median(c), 6) AS median, round(max(c), 6) AS high, CAST(count(*) AS BIGINT) AS n FROM (SELECT a.label, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) GROUP BY ALL")
def pair_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    j = e.join(b, "vec_id").select((F.col("label") % 2).alias("side"), A.cosine(F.col("embedding"), F.col("other")).alias("c"))
    j = cut(j)
    g = j.groupBy("side").agg(r6(F.min("c"), "low"), r6(F.avg("c"), "mean"), r6(F.max("c"), "high"), F.count(F.lit(1)).alias("n"))
    return g.join(A.quantiles(j, ["side"], "c", {"median": 0.5}).select("side", r6(F.col("median"), "median")), "side")


@query(
    """WITH s AS (SELECT c_mktsegment AS g, round(c_acctbal, 2) AS s, CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE 0 END AS y FROM customer), r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY s) + (count(*) OVER (PARTITION BY g, s) - 1) / 2.0 AS r FROM s),
 a AS (SELECT g, sum(r * y) AS rs, CAST(sum(y) AS DOUBLE) AS p, CAST(count(*) - sum(y) AS DOUBLE) AS n FROM r GROUP BY g), u AS (SELECT g, (rs - p * (p + 1) / 2) / (p * n) AS auc, p, n FROM a),
 h AS (SELECT *, sqrt(greatest((auc * (1 - auc) + (p - 1) * (auc / (2 - auc) - auc * auc) + (n - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (p * n), 0)) AS se FROM u)
 SELECT g AS segment, round(auc, 6) AS auc, round(greatest(auc - 1.96 * se, 0.0), 6) AS ci95_lo, round(least(auc + 1.96 * se, 1.0), 6) AS ci95_hi FROM h"""
)
def auc_rank(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.round("c_acctbal", 2).alias("s"), F.when(F.col("c_nationkey") % 2 == 0, 1).otherwise(0).alias("y"))
    u = A.auc(c, ["segment"], "s", "y")
    low, high = A.hanley_mcneil(F.col("auc"), F.col("positives").cast("double"), F.col("negatives").cast("double"))
    return u.select("segment", r6(F.col("auc"), "auc"), r6(low, "ci95_lo"), r6(high, "ci95_hi"))


@query("SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS {n}" for q, n in ((0.0, "low"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "high"))) + " FROM events GROUP BY event_type")
def boxplot_stats(spark: SparkSession, d: str) -> DataFrame:
    b = A.box(table(spark, d, "events"), ["event_type"], "value")
    return b.select("event_type", *[r6(F.col(c), c) for c in ("low", "q1", "median", "q3", "high")])


# --- judging ------------------------------------------------------------------------------------------------------------------

_JUDGED_SQL = """(SELECT *, (predicted <> 'UNKNOWN' AND (predicted = 'MÄNNISKA') = is_human) AS correct FROM (SELECT j.judge, q.item_id, q.register, q.condition, q.pair_id, q.is_human, CASE WHEN q.is_human THEN 'human' WHEN q.generator = 'gpt' AND q.register = 'informal' AND q.condition = 'baseline' THEN 'gpt-4o-mini' WHEN q.generator = 'gpt' THEN 'gpt-5.2' ELSE q.generator END AS generator,
 CASE WHEN substr(md5(j.judge || '|' || q.item_id), 1, 1) = '0' THEN 'UNKNOWN' WHEN substr(md5(j.judge || '|' || q.item_id), 1, 1) < '8' THEN 'AI' ELSE 'MÄNNISKA' END AS predicted, 50 + (strpos('0123456789abcdef', substr(md5(j.judge || '|' || q.item_id), 2, 1)) - 1) * 3 AS confidence
 FROM quiz_master_balanced q CROSS JOIN (VALUES ('j1'), ('j2')) j(judge) WHERE NOT EXISTS (SELECT 1 FROM quiz_master_balanced s WHERE s.supersedes = q.item_id)))"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Items that nothing supersedes, with the answers of two stand-in judges that a hash of the item gives."""
    q = P.supersede(table(spark, d, "quiz_master_balanced")).withColumn("judge", F.explode(F.array(F.lit("j1"), F.lit("j2"))))
    h = F.md5(F.concat_ws("|", "judge", F.col("item_id").cast("string")))
    first = F.substring(h, 1, 1)
    q = q.withColumn("predicted", F.when(first == "0", J.UNKNOWN).when(first < "8", J.MACHINE).otherwise(J.HUMAN)).withColumn("confidence", 50 + (F.locate("0", F.lit("0")) * 0 + F.expr("locate(substring(md5(concat_ws('|', judge, cast(item_id as string))), 2, 1), '0123456789abcdef')") - 1) * 3)
    q = q.withColumn("generator", J.relabel(F.col("generator"), F.col("register"), F.col("condition"), F.col("is_human")))
    return q.withColumn("correct", J.correct(F.col("predicted"), F.col("is_human"))).select("judge", "item_id", "register", "condition", "pair_id", "is_human", "generator", "predicted", "confidence", "correct")


@query(
    f"""WITH c AS (SELECT judge, register, count(*) FILTER (NOT is_human AND predicted = 'AI') AS tp, count(*) FILTER (is_human AND predicted = 'AI') AS fp, count(*) FILTER (is_human AND predicted = 'MÄNNISKA') AS tn, count(*) FILTER (NOT is_human AND predicted = 'MÄNNISKA') AS fn, count(*) AS n FROM {_JUDGED_SQL} GROUP BY judge, register),
 p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS re FROM c) SELECT judge, register, tp, fp, tn, fn, n, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END, 6) AS f1, round((tp + tn) / n, 6) AS accuracy FROM p"""
)
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    c = J.confusion(judged(spark, d), ["judge", "register"])
    return c.select("judge", "register", "tp", "fp", "tn", "fn", "n", *[r6(F.col(x), x) for x in ("precision", "recall", "f1", "accuracy")])


@query(
    f"""WITH g AS (SELECT judge, generator, CASE WHEN grouping(register) = 1 THEN '_HEADLINE_' ELSE register END AS register, CASE WHEN grouping(condition) = 1 THEN '_ALL_' ELSE condition END AS condition, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS k FROM {_JUDGED_SQL} GROUP BY GROUPING SETS ((judge, generator, register, condition), (judge, generator, register), (judge, generator)))
 SELECT judge, generator, register, condition, n, k AS n_correct, round(k / n, 6) AS recall, round(greatest((k / n + 3.8414588206941285 / (2 * n) - 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 3.8414588206941285 / (4.0 * n * n))) / (1 + 3.8414588206941285 / n), 0), 6) AS wilson_lo,
 round(least((k / n + 3.8414588206941285 / (2 * n) + 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 3.8414588206941285 / (4.0 * n * n))) / (1 + 3.8414588206941285 / n), 1), 6) AS wilson_hi FROM g"""
)
def recall_wilson(spark: SparkSession, d: str) -> DataFrame:
    r = J.recall_table(judged(spark, d))
    return r.select("judge", "generator", "register", "condition", "n", "n_correct", *[r6(F.col(x), x) for x in ("recall", "wilson_lo", "wilson_hi")])


@query(
    f"""WITH j AS {_JUDGED_SQL}, h AS (SELECT judge, count(*) AS nh, sum(CAST(correct AS INT)) AS hk FROM j WHERE is_human GROUP BY judge), m AS (SELECT judge, generator, count(*) AS na, sum(CAST(correct AS INT)) AS ak, avg(confidence) FILTER (correct) AS cc, avg(confidence) FILTER (NOT correct) AS cw FROM j WHERE NOT is_human GROUP BY judge, generator)
 SELECT judge, generator, CAST(nh + na AS BIGINT) AS n, CAST(hk + ak AS BIGINT) AS n_correct, CAST(na AS BIGINT) AS n_ai, CAST(nh AS BIGINT) AS n_human, round((hk + ak) / (nh + na), 6) AS overall_acc, round((hk / nh + ak / na) / 2, 6) AS balanced_acc, round(hk / nh, 6) AS human_recall, round(ak / na, 6) AS ai_recall, round(cc, 6) AS conf_correct, round(cw, 6) AS conf_wrong,
 CASE WHEN cc - cw > 2 THEN 'Calibrated' WHEN cc - cw < -2 THEN 'Inverted' ELSE 'Flat' END AS calibration FROM m JOIN h USING (judge)"""
)
def headline(spark: SparkSession, d: str) -> DataFrame:
    h = J.headline(judged(spark, d))
    return h.select("judge", "generator", "n", "n_correct", "n_ai", "n_human", *[r6(F.col(x), x) for x in ("overall_acc", "balanced_acc", "human_recall", "ai_recall", "conf_correct", "conf_wrong")], "calibration")


def _contrast_sql(keys: str, by: str) -> str:
    return f"""WITH o AS (SELECT {keys}, pair_id, {by} AS v, max(CAST(correct AS INT)) AS ok FROM {_JUDGED_SQL} WHERE NOT is_human GROUP BY ALL), p AS (SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, a.v AS name_a, b.v AS name_b, a.ok AS x, b.ok AS y FROM o a JOIN o b ON {' AND '.join(f'a.{k.strip()} = b.{k.strip()}' for k in keys.split(','))} AND a.pair_id = b.pair_id AND a.v < b.v)
 SELECT {keys}, name_a, name_b, CAST(count(*) AS BIGINT) AS n_pairs, CAST(count(*) FILTER (x = 1 AND y = 0) AS BIGINT) AS b, CAST(count(*) FILTER (x = 0 AND y = 1) AS BIGINT) AS c, round(avg(x), 6) AS recall_a, round(avg(y), 6) AS recall_b, round(avg(y) - avg(x), 6) AS delta FROM p GROUP BY ALL"""


@query(_contrast_sql("judge, generator, register", "condition"))
def condition_contrasts(spark: SparkSession, d: str) -> DataFrame:
    """Conditions against each other within a judge, generator and register, paired by pair_id."""
    c = J.contrasts(judged(spark, d).filter("NOT is_human"), ["judge", "generator", "register"], "condition")
    return c.select("judge", "generator", "register", "name_a", "name_b", "n_pairs", "b", "c", *[r6(F.col(x), x) for x in ("recall_a", "recall_b", "delta")])


@query(_contrast_sql("judge, register, condition", "generator"))
def generator_contrasts(spark: SparkSession, d: str) -> DataFrame:
    """Generators against each other within a judge, register and condition, paired by pair_id."""
    c = J.contrasts(judged(spark, d).filter("NOT is_human"), ["judge", "register", "condition"], "generator")
    return c.select("judge", "register", "condition", "name_a", "name_b", "n_pairs", "b", "c", *[r6(F.col(x), x) for x in ("recall_a", "recall_b", "delta")])


@query(
    "WITH t AS (" + _contrast_sql("judge, generator, register", "condition") + """), p AS (SELECT judge, generator, register, name_a, name_b, b, c, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda k: exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2.0))))) END AS p FROM t)
SELECT judge, generator, register, name_a, name_b, b, c, round(p, 6) AS p_value, CASE WHEN b + c = 0 THEN 'no-discordance' ELSE 'exact' END AS method, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS sig FROM p"""
)
def mcnemar_p(spark: SparkSession, d: str) -> DataFrame:
    return J.contrasts(judged(spark, d).filter("NOT is_human"), ["judge", "generator", "register"], "condition").select("judge", "generator", "register", "name_a", "name_b", "b", "c", r6(F.col("p_value"), "p_value"), "method", A.stars(F.col("p_value")).alias("sig"))


@query(
    f"""SELECT judge, item_id, CASE item_id % 5 WHEN 3 THEN 'MÄNNISKA' WHEN 4 THEN 'UNKNOWN' ELSE predicted END AS predicted, CAST(CASE item_id % 5 WHEN 0 THEN confidence WHEN 1 THEN confidence WHEN 2 THEN CASE WHEN predicted = 'UNKNOWN' THEN 0 ELSE 50 END WHEN 3 THEN 50 ELSE 0 END AS INT) AS confidence,
 CASE item_id % 5 WHEN 0 THEN coalesce(generator, '') WHEN 1 THEN '' WHEN 2 THEN 'Jag tror: ' || predicted WHEN 3 THEN '{{"classification": "Human", "confidence": "hög"}}' ELSE '' END AS reasoning FROM {_JUDGED_SQL}"""
)
def judge_parse(spark: SparkSession, d: str) -> DataFrame:
    """Raw answers as a judge would give them, of every kind, parsed."""
    j = judged(spark, d)
    raw = (
        F.when(F.col("item_id") % 5 == 0, F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("predicted").alias("classification"), "confidence", F.col("generator").alias("reasoning"))), F.lit("\n```")))
        .when(F.col("item_id") % 5 == 1, F.to_json(F.struct(F.col("predicted").alias("classification"), "confidence"))).when(F.col("item_id") % 5 == 2, F.concat(F.lit("Jag tror: "), F.col("predicted")))
        .when(F.col("item_id") % 5 == 3, F.lit('{"classification": "Human", "confidence": "hög"}')).otherwise(F.lit(""))
    )
    return j.select("judge", "item_id", J.parse_response(raw).alias("p")).select("judge", "item_id", "p.*")


@query(
    f"""WITH c AS (SELECT judge, register, count(*) AS n, sum(CAST(correct AS INT)) AS k, count(*) FILTER (NOT is_human AND predicted = 'AI') AS tp, count(*) FILTER (is_human AND predicted = 'MÄNNISKA') AS tn, count(*) FILTER (NOT is_human AND predicted = 'MÄNNISKA') AS fn, count(*) FILTER (NOT is_human) AS ai FROM {_JUDGED_SQL} GROUP BY ALL),
 s AS (SELECT judge, register, n, k / n AS acc, tn / nullif(tn + fn, 0) AS ph, tp / nullif(ai, 0) AS ra FROM c) SELECT judge, register, CAST(n AS BIGINT) AS n, round(acc, 6) AS accuracy, round(ph, 6) AS precision_human, round(ra, 6) AS recall_ai FROM s
 UNION ALL SELECT judge, '_ALL_', CAST(sum(n) AS BIGINT), round(sum(n * acc) / sum(n), 6), round(sum(n * ph) / sum(n), 6), round(sum(n * ra) / sum(n), 6) FROM s GROUP BY judge"""
)
def participant_pooling(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy, precision for human texts and recall for machine texts of each subgroup, and their means weighted by its size."""
    p = cut(J.pooled(judged(spark, d), ["judge"], "register"))
    return p.select("judge", "register", "n", *[r6(F.col(c), c) for c in ("accuracy", "precision_human", "recall_ai")])


@query(
    f"""WITH j AS (SELECT judge, CASE WHEN is_human THEN 'MÄNNISKA' ELSE 'AI' END AS truth, predicted FROM {_JUDGED_SQL}), l AS (SELECT DISTINCT judge, unnest(['MÄNNISKA', 'AI']) AS label FROM j),
 c AS (SELECT l.judge, label, count(*) FILTER (truth = label AND predicted = label) AS tp, count(*) FILTER (truth <> label AND predicted = label) AS fp, count(*) FILTER (truth = label AND predicted <> label) AS fn FROM l JOIN j USING (judge) GROUP BY ALL),
 m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS re FROM c)
 SELECT judge, label, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END, 6) AS f1, CAST(tp + fn AS BIGINT) AS support FROM m"""
)
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    j = judged(spark, d).withColumn("truth", F.when(F.col("is_human"), J.HUMAN).otherwise(J.MACHINE))
    r = J.report(j, ["judge"], "truth", "predicted", (J.HUMAN, J.MACHINE))
    return r.select("judge", "label", *[r6(F.col(c), c) for c in ("precision", "recall", "f1")], "support")


@query("WITH e AS (" + ORACLES["paired_effects_full"] + ") SELECT register, condition, arg_max(feature, (abs(cohens_dz), feature)) AS feature, round(max(abs(cohens_dz)), 6) AS largest, round(max(abs(cohens_dz)) FILTER (significant), 6) AS largest_significant FROM e GROUP BY register, condition")
def largest_effects(spark: SparkSession, d: str) -> DataFrame:
    """The feature with the largest absolute effect in each register and condition."""
    e = paired_effects_full(spark, d)
    size = F.abs("cohens_dz")
    return e.groupBy("register", "condition").agg(F.max_by("feature", F.struct(size, F.col("feature"))).alias("feature"), r6(F.max(size), "largest"), r6(F.max(F.when(F.col("significant"), size)), "largest_significant"))


ORACLES["mtld"] = ORACLES["mtld"].replace("MTLD,", _mtld_sql("w") + ",").replace("WORDS", ALPHA.format("text"))
QUERIES.update(modelled.queries())
ORACLES.update(modelled.oracle_sql())
ORACLES["audit_by_condition"] = C.audit(_long_sql(), NONEMPTY, _refusal_case())
ORACLES["top_effects"] = C.top_effects(_TESTS.format(k="register, condition, feature", f="register, condition", src=_features_sql()))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
