"""Per-document text features. Native expressions but for MTLD and part-of-speech-gated phrase matching, which carry state along the tokens."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from korpusverk.functions import texts as T
from korpusverk.functions.lexicons import CATEGORIES, FORMAL_CATEGORIES, FUNCTION_WORDS, HEDGE_POS, NEGATIONS

MARKS = {"period": (".",), "comma": (",",), "semicolon": (";",), "colon": (":",), "dash": ("–", "—"), "exclaim": ("!",), "question": ("?",), "ellipsis": ("...",)}
#: Marks that the formal register leaves out.
INFORMAL_MARKS = ("exclaim", "question", "ellipsis")
WINDOW = 100
MTLD_LIMIT = 0.72


def ttr(words: Column) -> Column:
    return T.ratio(F.size(F.array_distinct(words)).cast("double"), F.size(words))


def mattr(words: Column, window: int = WINDOW) -> Column:
    """Mean type-token ratio of all windows; that of the whole text if it is shorter, 0 if it has no word."""
    n = F.size(words)
    starts = F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))
    sums = F.aggregate(F.transform(starts, lambda i: F.size(F.array_distinct(F.slice(words, i, window))).cast("double")), F.lit(0.0), lambda a, x: a + x)
    return F.when(n < window, ttr(words)).otherwise(sums / F.size(starts) / window)


def _factors(words: list[str]) -> float:
    """Stretches of the text whose type-token ratio has fallen to the limit, the last one counted in part."""
    whole, start, types = 0, 0, set()
    for at, word in enumerate(words, 1):
        types.add(word)
        if len(types) <= MTLD_LIMIT * (at - start):
            whole, start, types = whole + 1, at, set()
    rest = len(words) - start
    return whole + ((1 - len(types) / rest) / (1 - MTLD_LIMIT) if rest else 0.0)


def _mtld_one_way(words: list[str]) -> float:
    return len(words) / (_factors(words) or 1.0)


@F.pandas_udf(DoubleType())
def mtld(words: pd.Series) -> pd.Series:
    """Mean of the forward and backward measure of textual lexical diversity; null under ten words."""
    return words.map(lambda w: None if w is None or len(w) < 10 else (_mtld_one_way(list(w)) + _mtld_one_way(list(w)[::-1])) / 2)


def ngram_repetition(words: Column, n: int) -> Column:
    """Share of n-grams that repeat an earlier one; case counts."""
    size = F.size(words) - (n - 1)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(size < 1, F.lit(0.0)).otherwise((size - F.size(F.array_distinct(grams))) / size.cast("double"))


def function_word_rate(words: Column) -> Column:
    listed = F.array(*[F.lit(w) for w in dict.fromkeys(FUNCTION_WORDS)])
    return T.ratio(F.size(F.filter(words, lambda w: F.array_contains(listed, w))).cast("double"), F.size(words))


def punctuation(text: Column, register: str = "informal") -> dict[str, Column]:
    """Marks per 100 tokens."""
    n = T.token_count(text)
    kept = {k: m for k, m in MARKS.items() if register == "informal" or k not in INFORMAL_MARKS}
    return {f"punct_{k}": T.ratio(sum((T.literal_count(text, x) for x in m), F.lit(0)).cast("double"), n, 100) for k, m in kept.items()}


def phrase_pattern(lexicon: tuple[str, ...]) -> str:
    """For words joined by two blanks with one at each end: longest phrases first, so matches neither overlap nor share a blank."""
    ordered = sorted(set(lexicon), key=lambda p: (-len(p.split()), p))
    return " (?:" + "|".join(re.escape(p).replace(r"\ ", "  ") for p in ordered) + ") "


def lexicon_count(words: Column, category: str) -> Column:
    """Non-overlapping, longest-first hits of the category's words and phrases."""
    spaced = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
    return F.regexp_count(spaced, F.lit(phrase_pattern(CATEGORIES[category]))).cast("bigint")


def lexicon_counts(df: DataFrame, words: str, register: str = "informal") -> DataFrame:
    """Adds <category>_count; the formal register leaves two categories out. The spaced text is made once for all categories."""
    names = CATEGORIES if register == "informal" else FORMAL_CATEGORIES
    spaced = df.withColumn("_spaced", F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" ")))
    return spaced.withColumns({f"{k}_count": F.regexp_count("_spaced", F.lit(phrase_pattern(CATEGORIES[k]))).cast("bigint") for k in names}).drop("_spaced")


def negation_sentence_rate(text: Column) -> Column:
    """Share of sentences with a negation."""
    pattern = r"(?iU)\b(?:" + "|".join(NEGATIONS) + r")\b"
    s = T.sentences(text)
    return T.ratio(F.size(F.filter(s, lambda x: x.rlike(pattern))).cast("double"), F.size(s))


@F.pandas_udf(LongType())
def gated_hedges(words: pd.Series, tags: pd.Series) -> pd.Series:
    """Hedges of a tagged text: longest phrases first, ambiguous single words only in their hedging part of speech."""
    by_length: dict[int, set] = {}
    for phrase in CATEGORIES["hedge"]:
        t = tuple(phrase.split())
        by_length.setdefault(len(t), set()).add(t)

    def count(ws, ts) -> int:
        ws, total, i = [w.lower() for w in ws], 0, 0
        while i < len(ws):
            step = 1
            for k in sorted(by_length, reverse=True):
                if tuple(ws[i : i + k]) in by_length[k] and not (k == 1 and ws[i] in HEDGE_POS and ts[i] not in HEDGE_POS[ws[i]]):
                    total, step = total + 1, k
                    break
            i += step
        return total

    return pd.Series([0 if w is None else count(w, t) for w, t in zip(words, tags)])


def readability(text: Column) -> dict[str, Column]:
    """Published formulas over vowel-group syllables; 0 for texts without words."""
    words, syl = F.size(T.alpha_tokens(text)).cast("double"), T.syllables(text).cast("double")
    s = F.greatest(F.size(T.sentences(text)), F.lit(1)).cast("double")
    heavy = F.size(F.filter(T.alpha_tokens(text), lambda w: F.regexp_count(w, F.lit("[aeiouyåäö]+")) >= 3)).cast("double")
    some = lambda c: F.when(words > 0, c).otherwise(F.lit(0.0))
    return {
        "flesch_reading_ease": some(206.835 - 1.015 * words / s - 84.6 * syl / words), "flesch_kincaid_grade": some(0.39 * words / s + 11.8 * syl / words - 15.59),
        "gunning_fog": some(0.4 * (words / s + 100 * heavy / words)), "smog_index": some(1.043 * F.sqrt(heavy * 30 / s) + 3.1291),
    }


def feature_table(df: DataFrame, keys: list[str], text_col: str, register: str = "informal") -> DataFrame:
    """keys and every native feature of the text; null texts are left out, as a pair without one side has no features. MTLD is null under ten words."""
    t = F.col(text_col)
    src = lexicon_counts(df.filter(t.isNotNull()).withColumn("_w", T.alpha_tokens(t)).withColumn("_s", T.surface_tokens(t)), "_w", register)
    w, s = F.col("_w"), F.col("_s")
    rates = {c[:-5] + "rate": T.ratio(F.col(c).cast("double"), F.size(w), 100) for c in src.columns if c.endswith("_count") and c[:-6] in CATEGORIES}
    named = {
        "n_alpha_tokens": F.size(w).cast("double"), "ttr": ttr(w), "mattr": mattr(w), "mtld": mtld(w), "bigram_repetition_rate": ngram_repetition(s, 2), "trigram_repetition_rate": ngram_repetition(s, 3),
        "function_word_rate": function_word_rate(w), "n_sentences": F.size(T.sentences(t)).cast("double"), "negation_sentence_rate": negation_sentence_rate(t),
    } | punctuation(t, register) | rates | {c: F.col(c).cast("double") for c in src.columns if c.endswith("_count") and c[:-6] in CATEGORIES}
    return src.select(*keys, *[v.alias(k) for k, v in named.items()])


def long_features(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature, value)."""
    names = [c for c in table.columns if c not in keys]
    return table.unpivot(keys, names, "feature", "value")


#: The group of each native feature, by the beginning of its name.
GROUPS = (("n_", "structure"), ("negation_sentence", "structure"), ("punct_", "punctuation"), ("bigram", "repetition"), ("trigram", "repetition"), ("ttr", "diversity"), ("mattr", "diversity"), ("mtld", "diversity"), ("function", "function_words"))


def group_of(feature: Column) -> Column:
    """structure, punctuation, repetition, diversity, function_words, or pragmatic for the marker families."""
    out = F.lit("pragmatic")
    for start, group in reversed(GROUPS):
        out = F.when(feature.startswith(start), group).otherwise(out)
    return out


def twins(columns: list[str], left: str = "human_", right: str = "llm_") -> list[str]:
    """Names x for which there are both a left-x and a right-x column, in the order of the table."""
    return [c[len(left) :] for c in columns if c.startswith(left) and right + c[len(left) :] in columns]


def twin_pairs(wide: DataFrame, keys: list[str], left: str = "human_", right: str = "llm_") -> DataFrame:
    """(keys, feature, human, llm) of the columns that have a twin; nothing if there are none."""
    names = twins(wide.columns, left, right)
    rows = [F.struct(F.lit(n).alias("feature"), F.col(left + n).cast("double").alias("human"), F.col(right + n).cast("double").alias("llm")) for n in names]
    none = F.array().cast("array<struct<feature:string,human:double,llm:double>>")
    return wide.select(*keys, F.explode(F.array(*rows) if rows else none).alias("f")).select(*keys, "f.*")


def side_features(texts: DataFrame, keys: list[str], side: str, left: str, text_col: str, register: str = "informal") -> DataFrame:
    """(keys, condition, feature, human, llm) from one row per key and side: every native feature of the left side against each other side of the same key.

    Each text's features are computed once; a key's few sides meet in one shuffle. Sides without text are left out.
    """
    table = feature_table(texts, [*keys, side], text_col, register)
    names = [c for c in table.columns if c not in (*keys, side)]
    packed = table.select(*keys, F.col(side).alias("_s"), F.array(*[F.round(c, 9) for c in names]).alias("_v"))
    sides = packed.groupBy(*keys).agg(F.max(F.when(F.col("_s") == left, F.col("_v"))).alias("_l"), F.collect_list(F.when(F.col("_s") != left, F.struct("_s", "_v"))).alias("_r")).filter("_l IS NOT NULL")
    pairs = sides.select(*keys, "_l", F.explode("_r").alias("r"))
    listed = F.array(*map(F.lit, names))
    return pairs.select(*keys, F.col("r._s").alias("condition"), F.explode(F.arrays_zip(listed.alias("feature"), F.col("_l").alias("human"), F.col("r._v").alias("llm"))).alias("f")).select(*keys, "condition", F.col("f.feature").alias("feature"), F.col("f.human").alias("human"), F.col("f.llm").alias("llm"))
