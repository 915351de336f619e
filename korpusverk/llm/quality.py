"""Per-document text quality statistics, and which texts are lists, tables or junk rather than prose.

Method: plain shares and means, and repetition statistics at every level: runs of a character, characters covered by the dominant 2-, 3- and
4-grams, duplicate lines and paragraphs, and lines that repeat the shape of another line (its mark or its columns). Combined rules separate lists and tables (repeated
shapes), boilerplate (repeated lines, paragraphs or phrases) and junk from prose; how word-like the letters are comes from trigram counts over the whole corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusverk.llm.letters import GRAMS, coded, count_table, grams, letter_counts, log_conditional, segment_sums
from korpusverk.plans.runtime import clash_free

WORD = re.compile(r"[^\W\d_]+")
MARK = re.compile(r"^\s*(?:[-*•·–+o»>]\s+|\d{1,3}[.):]\s+|[a-zA-Z][.)]\s+|\[[ xX]?\]\s*|[☐☑✓✔]\s*)")
ENDED = re.compile(r"[.!?…:;][\"')\]]*\s*$")
SENTENCE = re.compile(r"[.!?…](?:\s|$)")
#: Column separators of a table row, tried in this order.
SEPARATORS = (("|", re.compile(r"\s*\|\s*")), ("\t", re.compile(r"\t")), (";", re.compile(r"\s*;\s*")), (",", re.compile(r"\s*,\s*")), ("  ", re.compile(r" {2,}")))
CELL = re.compile(r"^(?:[-+~]?[\d.,:%/ ]+(?:kr|st|%|kg|cm|h)?|\?|-|–|n/a|na|nej|ja)?$", re.I)
MARKUP = re.compile(r"<[^<>\n]{1,80}>|&#?\w{1,8};|\{[^{}\n]{0,80}\}|\\[nrt]|;{2,}")
GARBLED = re.compile(r"Ã.|Â.?|ï¿½|â€.?|\ufffd|¼|½")
ODD = re.compile(r"[bcdfghjklmnpqrstvwxz]{4}|^[bcdfghjklmnpqrstvwxz]{3,}$")
#: Frequent Swedish words of running prose.
COMMON = frozenset("och i att det som en på är av för med till den har de inte om ett men var jag sig från vi så kan när man nu ska du han hon eller mycket vid detta där här även efter mot vad mig min sin bara skulle sedan".split())
STATS = (
    "char_count", "word_count", "mean_word_length", "symbol_ratio", "digit_ratio", "line_count", "ended_line_share", "common_word_share", "marked_line_share", "short_line_share",
    "table_line_share", "repeated_shape_share", "duplicate_line_share", "duplicate_paragraph_share", "top_bigram_share", "top_trigram_share", "top_fourgram_share", "longest_run_share", "longest_word", "distinct_word_share",
    "odd_word_share", "marked_char_share", "short_char_share", "markup_share", "garbled_share", "letter_score",
)


def table_rows(lines: list[str]) -> int:
    """Lines that repeat the column shape of another: at least two columns under one separator, most other cells numbers or fillers."""
    best = 0
    for mark, cut in SEPARATORS:
        rows = [[c for c in cut.split(x.strip().strip("|").strip())] for x in lines if mark in x.strip()]
        rows = [r for r in rows if len(r) >= 2]
        if len(rows) < 2:
            continue
        values = sum(1 for r in rows for c in r[1:] if CELL.match(c.strip()))
        cells = sum(len(r) - 1 for r in rows)
        usual = Counter(len(r) for r in rows).most_common(1)[0][0]
        alike = sum(1 for r in rows if abs(len(r) - usual) <= (mark == "  "))  # a wide cell may touch the next column
        if alike >= 2 and values >= 0.6 * cells and alike >= 0.7 * len(rows):
            best = max(best, len(rows))
    return best


def item_shape(line: str) -> str:
    """How the line begins: * for any bullet, 0 for a number, a for a letter, x for a box; short for a few words without a final mark; else nothing."""
    m = MARK.match(line)
    if m:
        mark = m.group().strip()
        return "x" if mark[0] in "[☐☑✓✔" else "0" if mark[0].isdigit() else "a" if mark[0].isalpha() and len(mark) > 1 else "*"
    return "short" if not ENDED.search(line) and 0 < len(WORD.findall(line)) <= 5 and not SENTENCE.search(line) else ""


def repeated_shapes(shapes: list[str]) -> int:
    """Items whose shape another line has too."""
    return sum(k for shape, k in Counter(shapes).items() if shape and k > 1)


def dominant(words: list[str], n: int, chars: int) -> float:
    if len(words) < 2 * n:
        return 0.0
    gram, k = Counter(zip(*(words[i:] for i in range(n)))).most_common(1)[0]
    return min(1.0, k * (sum(map(len, gram)) + n - 1) / chars) if k > 1 else 0.0


def longest_run(text: str) -> int:
    """Characters in runs of four or more of the same character."""
    return sum(len(m.group()) for m in re.finditer(r"(\S)\1{3,}", text))


def describe(text: str | None) -> tuple:
    """The statistics but letter_score; zeros for a null, empty or blank text."""
    t = text or ""
    body = t.strip()
    if not body:
        return (len(t), *([0.0] * (len(STATS) - 2)))
    low = body.lower()
    words = WORD.findall(low)
    solid = [c for c in body if not c.isspace()]
    letters = sum(map(len, words))
    digits = sum(c.isdigit() for c in solid)
    lines = [x for x in body.split("\n") if x.strip()]
    paragraphs = [x.strip() for x in re.split(r"\n\s*\n", low) if x.strip()]
    shapes = [item_shape(x) for x in lines]
    marked = [x for x, k in zip(lines, shapes) if k and k != "short"]
    short = [x for x in lines if not ENDED.search(x) and 0 < len(WORD.findall(x)) <= 5 and not SENTENCE.search(x)]
    n, size = len(lines), sum(map(len, lines))
    return (
        len(t), float(len(words)), letters / len(words) if words else 0.0, (len(solid) - letters - digits) / len(solid), digits / len(solid), float(n),
        sum(1 for x in lines if ENDED.search(x)) / n, sum(w in COMMON for w in words) / len(words) if words else 0.0, len(marked) / n, len(short) / n, table_rows(lines) / n, repeated_shapes(shapes) / n,
        1 - len({x.strip().lower() for x in lines}) / n, 1 - len(set(paragraphs)) / len(paragraphs), dominant(words, 2, len(body)), dominant(words, 3, len(body)), dominant(words, 4, len(body)),
        longest_run(body) / len(solid), float(max(map(len, body.split()))), len(set(words)) / len(words) if words else 0.0,
        sum(1 for w in words if ODD.search(w)) / len(words) if words else 0.0, sum(map(len, marked)) / size, sum(map(len, short)) / size,
        sum(len(m.group()) for m in MARKUP.finditer(body)) / len(body) if "<" in body or "&" in body or "{" in body or ";;" in body or "\\" in body else 0.0,
        sum(len(m.group()) for m in GARBLED.finditer(body)) / len(body) if not body.isascii() else 0.0,
    )


def repetitive(s: dict) -> bool:
    """Mostly repeated lines or paragraphs, one phrase over and over, or few words for the length (2,000 different ones are enough at any length)."""
    words = s["word_count"]
    return words >= 8 and (
        (s["line_count"] >= 4 and s["duplicate_line_share"] > 0.5) or s["duplicate_paragraph_share"] > 0.5
        or max(s["top_bigram_share"], s["top_trigram_share"], s["top_fourgram_share"]) > 0.6
        or s["distinct_word_share"] * words <= min(0.1 * words, 2000)
    )


def meaningless(s: dict) -> bool:
    """Symbols, runs of one character, one word over and over, encoded bytes, garbled or machine markup, random letters."""
    n, words = s["char_count"], s["word_count"]
    return (
        (words == 0 and s["symbol_ratio"] > 0.9 and n >= 8) or (s["symbol_ratio"] > 0.75 and n >= 12) or (s["longest_run_share"] > 0.6 and n >= 8)
        or (words >= 8 and s["distinct_word_share"] * words <= 2) or (s["longest_word"] >= 40 and s["longest_word"] > 0.6 * n)
        or s["markup_share"] > 0.5 or (s["garbled_share"] > 0.3 and n >= 8)
        or (words >= 1 and n >= 10 and s["common_word_share"] < 0.1 and (s["odd_word_share"] >= 0.34 and s["letter_score"] < -2.7 or s["odd_word_share"] >= 0.6 and s["letter_score"] < -2.2 or s["letter_score"] < -3.7))
    )


def kind(s: dict) -> str:
    """blank, junk, table, list, boilerplate, short or prose."""
    if not s["word_count"] and s["symbol_ratio"] + s["digit_ratio"] == 0:
        return "blank"
    if s["table_line_share"] > 0.5 and s["line_count"] >= 2:
        return "table"
    if meaningless(s):
        return "junk"
    if s["line_count"] >= 3 and s["repeated_shape_share"] > 0.5 and itemised(s) and not (repetitive(s) and s["duplicate_line_share"] > 0.8):  # lists name things twice
        return "list"
    if repetitive(s):
        return "boilerplate"
    return "short" if s["word_count"] < 4 else "prose"


def itemised(s: dict) -> bool:
    """Items are most of the lines and of the characters."""
    listed = s["marked_line_share"] > 0.5 and s["marked_char_share"] > 0.6
    plain = s["line_count"] >= 4 and max(s["short_line_share"], s["marked_line_share"]) > 0.6 and max(s["short_char_share"], s["marked_char_share"]) > 0.6
    return listed or plain


def text_statistics(df: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """One row per row of df: id, keep, the statistics of the whole text and its kind.

    Two passes, neither with a shuffle of texts: trigram counts of all texts (a table of 32,768 numbers), then the statistics. Null and
    blank texts get zeros and kind blank; repeated rows repeat; an empty table gives an empty result; unread columns don't matter.
    """
    src = clash_free(df, id_col, text_col, *keep)
    log_p = log_conditional(count_table(src, [text_col], GRAMS, letter_counts))
    table = df.sparkSession.sparkContext.broadcast(log_p.astype(np.float32))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f.pop(text_col).where(lambda x: x.notna(), None).tolist()
            codes, offsets = coded([t or "" for t in texts])
            g = grams(codes)
            inner = ((g >> 10) > 0) & (((g >> 5) & 31) > 0) & ((g & 31) > 0)
            n = segment_sums(inner, offsets)
            score = np.where(n > 0, segment_sums(np.where(inner, table.value[g], 0.0), offsets) / np.maximum(n, 1), 0.0)
            stats = pd.DataFrame([describe(t) for t in texts], columns=STATS[:-1], index=f.index)
            stats["letter_score"] = score
            stats["kind"] = [kind(r) for r in stats.to_dict("records")]
            stats["char_count"] = stats["char_count"].astype("int64")
            yield pd.concat([f, stats], axis=1)

    head = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in src.schema if x.name != text_col)
    body = ", ".join(f"{s} {'bigint' if s == 'char_count' else 'double'}" for s in STATS)
    return src.mapInPandas(run, f"{head}, {body}, kind string")


def not_prose(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind) of the lists, tables and junk; boilerplate says nothing of its own and counts as junk."""
    kinds = text_statistics(df, id_col, text_col).select(id_col, F.when(F.col("kind") == "boilerplate", "junk").otherwise(F.col("kind")).alias("kind"))
    return kinds.filter(F.col("kind").isin("list", "table", "junk"))
