"""Reading level of documents.

Method: a Rasch-style latent difficulty model with two facets, both fitted by maximum a posteriori likelihood in alternating, distributed steps.

* Words: a document of level t holds word w with probability proportional to exp(base_w + t * difficulty_w). Given the difficulties, each document's
  level solves one equation (its mean word difficulty equals the expected one); given the levels, each word's difficulty solves another (the mean level
  at its occurrences equals the expected one), drawn towards what words of that length have. Words with at least 2**-17 of all tokens, so never
  more than 2**17, have a difficulty of their own, told apart by 59-bit codes; the rarer ones share one for each length.
* Sentences: a document of level s goes on after the b-th word of a sentence with odds exp(s - stop_b), a Rasch model with the places b as items.

Levels are fitted on texts in one language and read in deviations from the corpus's middle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusverk.llm import languages
from korpusverk.llm.letters import count_table, segment_sums
from korpusverk.plans.runtime import clash_free, cut

ROUNDS = 4
#: A word has a difficulty of its own from 1/SHARE of all tokens and LEAST hits on.
SHARE, LEAST = 1 << 17, 5
#: Lengths of words and places in sentences from which on all are alike.
LONGEST, PLACES = 31, 40
#: Prior spread of difficulties around that of their length, and the slope of that by length in standard deviations.
SPREAD, SLOPE = 0.3, 0.4
LEVELS = np.linspace(-8.0, 8.0, 321)
DIFFICULTIES = np.linspace(-3.0, 3.0, 241)
#: Deviations from the middle from which on words and sentences count as far from usual (words, sentences): easy below, hard above.
EASY, HARD = (-4.0, 0.0), (4.0, 2.0)
FOOTER = re.compile(r"\s*(?:\*\*)?\b(?:nyckelord|keywords|ämnesord|sökord)(?:\*\*)?\s*:.*\Z", re.I | re.S)
SHORT_FORM = re.compile(r"\b(?:s\.\s?k|bl\.\s?a|d\.\s?v\.\s?s|t\.\s?ex|m\.\s?m|p\.\s?g\.\s?a|o\.\s?s\.\s?v|o\.\s?d|f\.\s?n|m\.\s?fl|e\.\s?d|fr\.\s?o\.\s?m|t\.\s?o\.\s?m|resp|ca|kap|jfr|etc|dvs|nr|st)\.", re.I)
WORD = re.compile(r"[^\W\d_]+")
STOP = re.compile(r"[.!?…]+(?=[\s\"”»')\]*]|\Z)|\n\s*\n")
STAND_INS = frozenset(("", "nan", "null", "none", "na", "saknas"))


def body(text: str | None) -> str:
    """The text without keyword footer, headings and emphasis; '' for null and for stand-ins."""
    t = FOOTER.sub("", text or "")
    t = re.sub(r"(?m)^\s*#{1,6}\s.*$|[*_`]+", " ", t)
    return "" if t.strip(" .-").lower() in STAND_INS else t


def sentence_count(bare: str) -> int:
    """Sentences of a text that body() has cleaned."""
    return sum(1 for s in STOP.split(SHORT_FORM.sub("x", bare)) if WORD.search(s))


def codes_of(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(code of each word, offsets); the last five bits of a code are the word's length."""
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
    at, forms = pd.factorize(np.array([w for ws in words for w in ws], dtype=object))
    if not len(at):
        return np.zeros(0, np.int64), offsets
    h = pd.util.hash_array(forms.astype(object), categorize=False) & ~np.uint64(LONGEST)
    return (h | np.minimum(np.fromiter(map(len, forms), np.uint64, len(forms)), np.uint64(LONGEST)))[at].view(np.int64), offsets


def parsed(df: DataFrame, id_col: str, text_col: str, language_table: np.ndarray, language: str) -> DataFrame:
    """(id, language, letters, codes, sentences) of every row, written once; word codes and sentence lengths only of texts in the language."""
    shared = df.sparkSession.sparkContext.broadcast(language_table)  # fixed size
    kind = df.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [body(t) for t in batch.column(1).to_pylist()]
            words = [WORD.findall(t.lower()) for t in texts]
            best = languages.posteriors(texts, shared.value).argmax(1)
            tongue = [languages.LANGUAGES[k] if w else None for k, w in zip(best, words)]
            own = [w if x == language else [] for w, x in zip(words, tongue)]
            codes, offsets = codes_of(own)
            lengths = [[len(WORD.findall(s)) for s in STOP.split(SHORT_FORM.sub("x", t))] if w else [] for t, w in zip(texts, own)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(tongue, pa.string()), pa.array([sum(map(len, w)) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(codes)),
                pa.array([[n for n in x if n] for x in lengths], pa.list_(pa.int32())),
            ], names=[id_col, "language", "letters", "codes", "sentences"])

    return cut(df.mapInArrow(run, f"`{id_col}` {kind}, language string, letters bigint, codes array<bigint>, sentences array<int>"))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column without nulls."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def vocabulary(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted codes of the words with a difficulty of their own, tokens of each item); items: those words, then one for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, n = np.unique(flat(batch.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

    counts = cut(texts.select("codes").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")))
    by_length = counts.groupBy(F.col("code").bitwiseAND(LONGEST).alias("length")).agg(F.sum("n").alias("n")).toPandas()
    tokens = np.zeros(LONGEST + 1)
    tokens[by_length["length"]] = by_length["n"]
    rows = counts.filter(F.col("n") >= max(LEAST, tokens.sum() / SHARE)).toArrow()  # at most SHARE rows
    code, n = rows["code"].to_numpy(), rows["n"].to_numpy().astype(np.float64)
    order = np.argsort(code)
    code, n = code[order], n[order]
    return code, np.concatenate([n, np.maximum(tokens - np.bincount(code & LONGEST, n, LONGEST + 1), 0.0)])


def items_of(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, codes)
    hit = known[np.minimum(at, len(known) - 1)] == codes if len(known) else np.zeros(len(codes), bool)
    return np.where(hit, at, len(known) + (codes & LONGEST))


class Words:
    """The words' facet: difficulties and bases of items, and what documents expect at each level."""

    def __init__(self, known: np.ndarray, tokens: np.ndarray):
        self.known, self.tokens = known, tokens
        length = np.concatenate([known & LONGEST, np.arange(LONGEST + 1)]).astype(np.float64)
        n = max(tokens.sum(), 1.0)
        mean = (tokens * length).sum() / n
        sd = np.sqrt((tokens * (length - mean) ** 2).sum() / n) or 1.0
        self.prior = SLOPE * (length - mean) / sd
        self.difficulty, self.base = self.prior.copy(), np.log(np.maximum(tokens, 0.5) / n)
        self.expect()

    def expect(self) -> None:
        """Log normaliser, mean and variance of the difficulty at each level."""
        self.log_z, self.mean, self.var = (np.empty(len(LEVELS)) for _ in range(3))
        for k, t in enumerate(LEVELS):
            x = self.base + t * self.difficulty
            top = x.max()
            p = np.exp(x - top)
            self.log_z[k] = top + np.log(p.sum())
            p /= p.sum()
            self.mean[k] = p @ self.difficulty
            self.var[k] = p @ self.difficulty**2 - self.mean[k] ** 2

    def levels(self, items: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each document's level, under a standard normal prior."""
        n, total, t = np.diff(offsets), segment_sums(self.difficulty[items], offsets), np.zeros(len(offsets) - 1)
        for _ in range(12):
            step = (total - n * np.interp(t, LEVELS, self.mean) - t) / (n * np.interp(t, LEVELS, self.var) + 1.0)
            t = np.clip(t + np.clip(step, -1, 1), LEVELS[0], LEVELS[-1])
        return t

    def update(self, sums: np.ndarray, weights: np.ndarray) -> None:
        """Difficulties from the levels at the items' occurrences (sums) and the tokens at each level (weights)."""
        w = np.log(np.maximum(weights, 1e-300)) - self.log_z
        x = w[None, :] + DIFFICULTIES[:, None] * LEVELS[None, :]
        top = x.max(1, keepdims=True)
        p = np.exp(x - top)
        norm = top[:, 0] + np.log(p.sum(1))
        p /= p.sum(1, keepdims=True)
        mean = p @ LEVELS
        var = p @ LEVELS**2 - mean**2
        seen, d = sums / np.maximum(self.tokens, 1.0), self.difficulty
        for _ in range(12):
            step = (self.tokens * (seen - np.interp(d, DIFFICULTIES, mean)) - (d - self.prior) / SPREAD**2) / (self.tokens * np.interp(d, DIFFICULTIES, var) + 1 / SPREAD**2)
            d = np.clip(d + np.clip(step, -0.3, 0.3), DIFFICULTIES[0], DIFFICULTIES[-1])
        self.difficulty, self.base = d, np.log(np.maximum(self.tokens, 0.5)) - np.interp(d, DIFFICULTIES, norm)
        self.expect()


def steps(lengths: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sentences that reach place b, sentences that go on after it) of each document, for b = 1 to PLACES."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    table = np.bincount(doc * (PLACES + 1) + np.minimum(lengths, PLACES + 1) - 1, minlength=n * (PLACES + 1)).reshape(n, PLACES + 1)
    reach = table[:, ::-1].cumsum(1)[:, ::-1].astype(np.float64)
    return reach[:, :-1], reach[:, 1:]


def goes_on(level: np.ndarray, stops: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(stops[None, :] - level[:, None]))


def sentence_levels(reach: np.ndarray, on: np.ndarray, stops: np.ndarray) -> np.ndarray:
    s = np.zeros(len(reach))
    for _ in range(8):
        p = goes_on(s, stops)
        s += np.clip(((on - reach * p).sum(1) - s) / ((reach * p * (1 - p)).sum(1) + 1.0), -1, 1)
    return s


def fit(texts: DataFrame, rounds: int = ROUNDS) -> tuple[Words, np.ndarray]:
    """(words' facet, stops of the sentences' facet) from parsed texts; each round is one pass over them, and what reaches the driver has a fixed bound."""
    words = Words(*vocabulary(texts))
    stops = np.zeros(PLACES)
    k = len(words.tokens)
    for turn in range(rounds):
        shared = texts.sparkSession.sparkContext.broadcast((words, stops))  # at most SHARE items

        def sums(batch: pa.RecordBatch, shared=shared, turn=turn) -> np.ndarray:
            words, stops = shared.value
            codes, offsets = flat(batch.column(0))
            items, n = items_of(codes, words.known), np.diff(offsets)
            level = words.levels(items, offsets)
            reach, on = steps(*flat(batch.column(1)))
            p = goes_on(sentence_levels(reach, on, stops) if turn else np.zeros(len(reach)), stops)
            near = np.rint((level - LEVELS[0]) / (LEVELS[1] - LEVELS[0])).astype(np.int64)
            return np.concatenate([np.bincount(items, np.repeat(level, n), k), np.bincount(near, n, len(LEVELS)), (reach * p - on).sum(0), (reach * p * (1 - p)).sum(0)])

        got = count_table(texts, ["codes", "sentences"], k + len(LEVELS) + 2 * PLACES, sums, lists=False)
        at, weights, surplus, curve = np.split(got, [k, k + len(LEVELS), k + len(LEVELS) + PLACES])
        words.update(at, weights)
        stops = stops + np.clip(surplus / (curve + 1e-3), -2, 2)
    return words, stops


def reading_levels(df: DataFrame, id_col: str, text_col: str, language_table: np.ndarray, language: str = "sv") -> DataFrame:
    """(id, level_score, word_level, sentence_level, word_length, sentence_length, language, level) of every row.

    word_level and sentence_level: the document's two latent levels, in deviations (1.4826 times the median one) from the corpus's median; level_score: their
    mean. level: easy or hard where both are far from the middle on the same side, ordinary for other texts in the language, other for texts in another
    language, none for null, blank and stand-in texts. Keyword footers don't count. Repeated rows repeat; an empty table gives an empty result.
    """
    texts = parsed(clash_free(df, id_col, text_col), id_col, text_col, language_table, language)
    own = F.col("language") == language
    words, stops = fit(texts.filter(own))
    shared = df.sparkSession.sparkContext.broadcast((words, stops))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stops = shared.value
        for batch in batches:
            codes, offsets = flat(batch.column(3))
            reach, on = steps(*flat(batch.column(4)))
            held = pa.array(np.diff(offsets) == 0)
            word = pa.array(words.levels(items_of(codes, words.known), offsets), mask=held.to_numpy(zero_copy_only=False))
            sentence = pa.array(sentence_levels(reach, on, stops), mask=held.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), word, sentence, batch.column(2), pa.array(np.diff(offsets)), pa.array(reach[:, 0].astype(np.int64)), batch.column(1)], names=[id_col, "_w", "_s", "_letters", "_words", "_sentences", "language"])

    kind = texts.schema[0].dataType.simpleString()
    scored = cut(texts.mapInArrow(run, f"`{id_col}` {kind}, _w double, _s double, _letters bigint, _words bigint, _sentences bigint, language string"))
    mid = scored.agg(*[F.percentile_approx(c, 0.5, 10_000).alias(c) for c in ("_w", "_s")]).first()
    far = scored.agg(*[F.percentile_approx(F.abs(F.col(c) - F.lit(mid[c])), 0.5, 10_000).alias(c) for c in ("_w", "_s")]).first()
    for name, c in (("word_level", "_w"), ("sentence_level", "_s")):
        scored = scored.withColumn(name, (F.col(c) - F.lit(mid[c])) / F.lit(max(1.4826 * (far[c] or 0.0), 0.05)))
    level = (
        F.when(F.col("language").isNull(), "none").when(~own, "other")
        .when((F.col("word_level") <= EASY[0]) & (F.col("sentence_level") <= EASY[1]), "easy").when((F.col("word_level") >= HARD[0]) & (F.col("sentence_level") >= HARD[1]), "hard").otherwise("ordinary")
    )
    n = F.nullif(F.col("_words"), F.lit(0))
    return scored.select(id_col, ((F.col("word_level") + F.col("sentence_level")) / 2).alias("level_score"), "word_level", "sentence_level", F.when(own, F.col("_letters") / n).alias("word_length"), (n / F.nullif(F.col("_sentences"), F.lit(0))).alias("sentence_length"), "language", level.alias("level"))
