"""Keyword-stuffed and link-list pages.

Method: pointwise mutual information of neighbouring words from counts over the whole corpus. Pairs are counted exactly (partial counts in each
task, then one shuffle of distinct pairs), and every count of two or more is used, at any corpus size: those that make up at least 2**-20 of all pairs,
so never more than 2**20, are broadcast; pages get the counts of rarer pairs and words through shuffles, in which no key has more rows than such a share. Two numbers
follow for each page:

* mean_pmi, how well its neighbouring words go together elsewhere in the corpus: low in a word salad;
* excess, the information that the page's repeated collocations carry about it: how much oftener than in the corpus they stand here.

The score is excess less mean_pmi in deviations from the corpus's middle, drawn towards 0 for short pages. Links count as one word, and so do numbers, so that lists of links and
rows of products are repeated collocations too. Pages of fragments need a lower score than pages of sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusverk.plans.runtime import clash_free, cut

#: Counts of words and pairs with at least 1/SHARE of the corpus are broadcast, smaller ones are joined. In excess a pair has at least this probability, so that scores do not rise with the corpus.
SHARE = 1 << 20
LINK = re.compile(r"(?:<a\s[^>]*href=[\"']?[^>\s]*>[^<]*</a>)|(?:\[url=?[^\]\s]*\][^\[]*\[/url\])|(?:\[[^\]\n]{0,80}\]\([^)\s]+\))|(?:h(?:tt|xx)ps?://|www\.)[^\s<>\"')\]|]+|\b(?:[a-z0-9åäö-]+\.)+[a-z]{2,}(?:[/?][^\s<>\"')\]|]*)?\b", re.I)
#: Without one of these, in lower case, there is no link.
LINKED = re.compile(r"\.[a-z]{2}|://|\[url|<a\s|\]\(")
#: A link and the end of a text in a batch's one string.
ONE, END = "\x02", "\x01"
WORD = r"[^\W_]+(?:-[^\W_]+)*"
BREAK = r"[\n|>·•;,#()\[\]<:!?=\"/]|\.(?=\s)|(?<=\s)[-–*](?=\s)"
WORDS = re.compile(f"{WORD}|{ONE}|{END}")
PARTS = re.compile(f"{WORD}|{ONE}|{END}|{BREAK}")
#: fragment_share: words in pieces of at most three words between marks, a link being such a piece; link_share: characters in links.
FIELDS = ("words", "mean_pmi", "excess", "fragment_share", "link_share")
#: Pages with fewer words and links are never judged; a collocation counts as repeated from so many times in a page.
LEAST, OFTEN = 4, 3
#: How much a deviation of mean_pmi weighs against a nat of excess, the share that makes a page one of fragments, and the scores from which pages are spam.
WEIGHT, FRAGMENTS, LOOSE, WHOLE = 0.25, 0.6, 0.6, 2.55
#: Pairs' worth of an unremarkable text in a page's score.
PRIOR = 8


class Batch:
    """The words of a batch of texts as codes, in order; a link is one word and so is any number. With marks: also which piece between marks each word is in."""

    def __init__(self, texts: list[str], marks: bool = False):
        low, self.link_share = [], np.zeros(len(texts))
        for i, t in enumerate(texts):
            t = t.lower()
            if ONE in t or END in t:
                t = t.replace(ONE, " ").replace(END, " ")
            if LINKED.search(t):
                self.link_share[i] = sum(len(m.group()) for m in LINK.finditer(t)) / (len(t.strip()) or 1)
                t = LINK.sub(f" {ONE} ", t)
            low.append(t)
        at, forms = pd.factorize(np.array((PARTS if marks else WORDS).findall(f"\n{END}\n".join([*low, ""])), dtype=object))
        kind = np.array([2 if f == END else 1 if f == ONE else 3 if not f[0].isalnum() else 4 if f.isdecimal() else 0 for f in forms], np.int8)[at]
        names = np.array(["0" if f.isdecimal() else f for f in forms], dtype=object)
        text = np.cumsum(kind == 2) - (kind == 2)
        word = (kind < 2) | (kind == 4)
        self.n = len(texts)
        self.codes = pd.util.hash_array(names, categorize=False)[at[word]] if len(at) else np.zeros(0, np.uint64)
        self.text = text[word]
        self.sizes = np.bincount(self.text, minlength=self.n)
        i = np.flatnonzero(self.text[1:] == self.text[:-1])
        self.place, self.pair_text = i, self.text[i]
        pairs = self.codes[i] * np.uint64(0x9E3779B97F4A7C15) ^ (self.codes[i + 1] + np.uint64(0x165667B19E3779F9)) * np.uint64(0xC2B2AE3D27D4EB4F)
        self.pairs = (pairs ^ (pairs >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        if marks:
            piece = np.cumsum((kind > 0) & (kind < 4))
            named = kind == 0
            n = np.bincount(piece[named], minlength=len(at) + 1)
            links = np.bincount(text[kind == 1], minlength=self.n)
            short = np.bincount(text[named], n[piece[named]] <= 3, self.n) + links
            self.fragments = short / np.maximum(np.bincount(text[named], minlength=self.n) + links, 1)


def corpus(df: DataFrame, text_col: str) -> tuple[DataFrame, int, int]:
    """((kind, code, n) of every word (0) and pair (1) with two hits or more, words, pairs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Batch([t for t in batch.column(0).to_pylist() if t])
            for kind, c in ((0, found.codes), (1, found.pairs)):
                some, n = np.unique(c, return_counts=True)
                some, n = np.append(some.view(np.int64), kind), np.append(n, len(c))
                kinds = np.full(len(some), kind, np.int32)
                kinds[-1] = 2
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(some), pa.array(n)], names=["kind", "code", "n"])

    counts = df.select(text_col).mapInArrow(run, "kind int, code bigint, n bigint").groupBy("kind", "code").agg(F.sum("n").alias("n"))
    counts = cut(counts.filter("n > 1 OR kind = 2"))
    totals = {r["code"]: r["n"] for r in counts.filter("kind = 2").collect()}
    return counts.filter("kind < 2"), totals.get(0, 0), totals.get(1, 0)


def frequent(counts: DataFrame, n_words: int, n_pairs: int) -> tuple:
    """(words, pairs, sorted word codes, counts, sorted pair codes, counts): totals, and what has at least 1/SHARE of them and two hits."""
    out = [n_words, n_pairs]
    for kind, total in ((0, n_words), (1, n_pairs)):
        rows = counts.filter((F.col("kind") == kind) & (F.col("n") >= total / SHARE)).select("code", "n").toArrow()  # at most SHARE rows
        code = rows["code"].to_numpy().view(np.uint64)
        order = np.argsort(code)
        out += [code[order], rows["n"].to_numpy()[order]]
    return tuple(out)


def count_corpus(df: DataFrame, text_col: str) -> tuple:
    """frequent() of a corpus; rarer words and pairs are in corpus()."""
    return frequent(*corpus(df, text_col))


def find(known: np.ndarray, values: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The value of each code, 0 for unknown ones."""
    if not len(known):
        return np.zeros(len(codes))
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return np.where(known[at] == codes, values[at], 0).astype(np.float64)


def measures(batch: Batch, counts: tuple, rest: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(mean_pmi, excess) of each text.

    A pair's own hits in the text are left out of its count; pairs that stand once in the corpus have PMI 0. Pairs that counts lacks, or a word of which it lacks,
    have PMI 0 here too and are told to rest, a list for each text: their codes, hits, words that counts lacks (else 0) and the log counts of those that it has.
    """
    n_words, n_pairs, word_codes, word_n, pair_codes, pair_n = counts
    if rest is not None:
        rest += [([], [], [], [], [])] * batch.n
    if not len(batch.pairs):
        return np.zeros(batch.n), np.zeros(batch.n)
    forms, at, which = np.unique(batch.pairs, return_index=True, return_inverse=True)
    key, hits = np.unique(batch.pair_text * len(forms) + which, return_counts=True)
    doc, pair = key // len(forms), key % len(forms)
    one, two = (find(word_codes, word_n, batch.codes[batch.place[at] + k])[pair] for k in (0, 1))
    seen = find(pair_codes, pair_n, forms)[pair]
    size = np.maximum(batch.sizes - 1, 1)
    known = (seen > 0) & (one > 0) & (two > 0)
    with np.errstate(divide="ignore"):
        pmi = np.where(known, np.log(np.maximum(seen - hits, 0.5) * n_words / np.where(known, one * two, 1.0)), 0.0)
        surplus = np.log(hits / size[doc]) - np.log(np.maximum(np.maximum(seen, hits), n_pairs / SHARE) / n_pairs)
    if rest is not None and not known.all():
        far = np.flatnonzero(~known)
        codes = [np.where(n[far] > 0, np.uint64(0), batch.codes[batch.place[at[pair[far]]] + k]).view(np.int64) for k, n in ((0, one), (1, two))]
        parts = (forms[pair[far]].view(np.int64), hits[far], *codes, np.log(np.maximum(one[far], 1) * np.maximum(two[far], 1)))
        ends = np.searchsorted(doc[far], np.arange(batch.n + 1))
        rest[-batch.n :] = [tuple(x[i:j] for x in parts) for i, j in zip(ends, ends[1:])]
    mean = np.bincount(doc, hits * pmi, batch.n) / size
    often = hits >= OFTEN
    return mean, np.bincount(doc[often], (hits * np.maximum(surplus, 0.0))[often], batch.n) / size


REST = {"_pairs": "array<bigint>", "_hits": "array<bigint>", "_one": "array<bigint>", "_two": "array<bigint>", "_held": "array<double>"}


def with_rare_pairs(pages: DataFrame, counts: DataFrame, n_words: int) -> DataFrame:
    """pages with the REST of their pairs added to mean_pmi: one shuffle by pair for its count, one by word for the words without a broadcast count."""
    pages = pages.withColumn("_page", F.monotonically_increasing_id())  # over files of the checkpoint: the same each time
    pairs, words = (counts.filter(F.col("kind") == kind).select(F.col("code").alias("_code"), "n").hint("merge") for kind in (1, 0))
    rows = pages.select("_page", F.explode(F.arrays_zip(*REST)).alias("r")).select("_page", "r.*")
    known = rows.join(pairs, F.col("_pairs") == F.col("_code")).withColumn("v", F.col("_hits") * (F.log(F.greatest(F.col("n") - F.col("_hits"), F.lit(0.5)) * n_words) - F.col("_held")))
    known = known.select("_page", F.explode(F.array(F.struct("v", F.lit(0).cast("bigint").alias("w"), F.lit(0).cast("bigint").alias("h")), *[F.struct(F.lit(0.0).alias("v"), F.col(c).alias("w"), F.col("_hits").alias("h")) for c in ("_one", "_two")])).alias("r")).select("_page", "r.*")
    known = cut(known.filter("w <> 0 OR v <> 0").groupBy("_page", "w").agg(F.sum("v").alias("v"), F.sum("h").alias("h")))
    rare = known.filter("w <> 0").join(words, F.col("w") == F.col("_code")).select("_page", (-F.col("h") * F.log("n")).alias("v"))
    more = known.filter("w = 0").select("_page", "v").unionByName(rare).groupBy("_page").agg(F.sum("v").alias("_v")).hint("merge")
    mean = F.col("mean_pmi") + F.coalesce(F.col("_v"), F.lit(0.0)) / F.greatest(F.col("words") - 1, F.lit(1.0))
    return pages.drop(*REST).join(more, "_page", "left").withColumn("mean_pmi", mean).drop("_page", "_v")


def page_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, FIELDS, score) of every row; zeros and a null score for a null, empty or blank text.

    Two passes over whole texts and one shuffle of distinct pairs, in corpora of over 2 x SHARE words also one of the pages' rarer pairs; repeated rows repeat;
    an empty table gives an empty result; other columns are not read.
    """
    src = clash_free(df, id_col, text_col)
    counts, n_words, n_pairs = corpus(src, text_col)
    shared = df.sparkSession.sparkContext.broadcast(frequent(counts, n_words, n_pairs))  # at most 2 x SHARE codes with counts
    large = n_words > 2 * SHARE  # else every count of two is broadcast

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found, rest = Batch([t if isinstance(t, str) else "" for t in f.pop(text_col)], marks=True), [] if large else None
            pmi, excess = measures(found, shared.value, rest)
            out = {"words": found.sizes.astype(np.float64), "mean_pmi": pmi, "excess": excess, "fragment_share": found.fragments, "link_share": found.link_share}
            yield pd.concat([f, pd.DataFrame(out | ({c: [r[k] for r in rest] for k, c in enumerate(REST)} if large else {}), index=f.index)], axis=1)

    columns = {x: "double" for x in FIELDS} | (REST if large else {})
    pages = cut(src.mapInPandas(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, " + ", ".join(f"{x} {t}" for x, t in columns.items())))
    if large:
        pages = cut(with_rare_pairs(pages, counts, n_words))
    judged = pages.filter(F.col("words") >= LEAST)
    mid = judged.agg(F.percentile_approx("mean_pmi", 0.5, 10_000)).first()[0]
    if mid is None:
        return pages.withColumn("score", F.lit(None).cast("double"))
    spread = judged.agg(F.percentile_approx(F.abs(F.col("mean_pmi") - mid), 0.5, 10_000)).first()[0]
    pairs = F.col("words") - 1
    score = (F.col("excess") - WEIGHT * (F.col("mean_pmi") - mid) / max(spread, 0.05)) * pairs / (pairs + PRIOR)
    return pages.withColumn("score", F.when(F.col("words") >= LEAST, score))


def spam_pages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id) of the pages that are mainly repeated keywords, links or product tags; thresholds hold for the score, whose middle is the corpus's own."""
    return page_features(df, id_col, text_col).filter(f"score >= CASE WHEN fragment_share >= {FRAGMENTS} THEN {LOOSE} ELSE {WHOLE} END").select(id_col)
