"""Language posteriors from character trigrams by naive Bayes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusverk.llm.letters import GRAMS, coded, count_table, grams, log_conditional, segment_sums

LANGUAGES = ("sv", "en", "no", "da", "de", "fi")


def scores(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Log-likelihood of each text (rows) under each language (columns of table: GRAMS x languages); other scripts count for none."""
    codes, offsets = coded([t.lower() for t in texts])
    g = grams(codes)
    seen = (g >> 10) + ((g >> 5) & 31) > 0
    g = g[: len(codes)]
    out = np.empty((len(texts), table.shape[1]))
    for k in range(table.shape[1]):
        out[:, k] = segment_sums(np.where(seen, table[g, k], 0.0), offsets)
    return out


def posteriors(texts: list[str], table: np.ndarray) -> np.ndarray:
    s = scores(texts, table)
    s -= s.max(1, keepdims=True)
    e = np.exp(s)
    return e / e.sum(1, keepdims=True)


def fit(df: DataFrame, text_col: str, lang_col: str, languages: Sequence[str] = LANGUAGES) -> np.ndarray:
    """log p(trigram | language) from all labelled rows; labels that the first fit finds wrong are left out of the second."""
    names = list(languages)
    labelled = df.filter(F.col(lang_col).isin(*names) & F.col(text_col).isNotNull())

    def counts(keep):
        def of(columns):
            texts, langs = columns
            total = np.zeros(GRAMS * len(names))
            fine = keep(texts)
            for k, name in enumerate(names):
                own = [t.lower() for t, x, best in zip(texts, langs, fine) if x == name and best in (None, k)]
                if own:
                    total[k * GRAMS : (k + 1) * GRAMS] += np.bincount(grams(coded(own)[0]), minlength=GRAMS)
            return total

        return of

    def table(c):
        return np.stack([log_conditional(part) for part in c.reshape(len(names), GRAMS)], axis=1).astype(np.float32)

    first = table(count_table(labelled, [text_col, lang_col], GRAMS * len(names), counts(lambda ts: [None] * len(ts))))
    return table(count_table(labelled, [text_col, lang_col], GRAMS * len(names), counts(lambda ts: scores(ts, first).argmax(1).tolist())))
