"""Measures over token negative log-likelihoods, whatever model gave them: (doc_id, sent, window, i, nll)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusverk.operators.skew import hot_join
from korpusverk.plans.runtime import cut


def windows(tokens: Column, size: int = 1024, stride: int = 512) -> Column:
    """Sliding windows with the number of tokens that are new in each: ARRAY<STRUCT<tokens, fresh>>."""
    n = F.size(tokens)
    last = F.greatest(F.ceil((n - size) / stride), F.lit(0)).cast("int")
    at = lambda k: k * stride
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(F.slice(tokens, at(k) + 1, size).alias("tokens"), F.when(k == 0, F.least(n, F.lit(size))).otherwise(F.least(at(k) + size, n) - (at(k - 1) + size)).alias("fresh")))


def perplexity(nll: DataFrame) -> DataFrame:
    """exp of the unweighted mean of the windows' means; null under two tokens."""
    w = nll.groupBy("doc_id", "window").agg(F.avg("nll").alias("m"), F.count(F.lit(1)).alias("n"))
    return w.groupBy("doc_id").agg(F.when(F.sum("n") >= 2, F.exp(F.avg("m"))).alias("perplexity"), F.sum("n").alias("n_tokens"))


def burstiness(nll: DataFrame) -> DataFrame:
    """Sample deviation of the sentences' perplexities; null under two sentences."""
    s = nll.groupBy("doc_id", "sent").agg(F.exp(F.avg("nll")).alias("ppl"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return s.groupBy("doc_id").agg(F.when(F.count(F.lit(1)) >= 2, F.stddev_samp("ppl")).alias("burstiness"))


def surprisal(nll: DataFrame, threshold: float = 10.0) -> DataFrame:
    n = F.count(F.lit(1))
    ok = lambda c: F.when(n >= 2, c)
    q = F.percentile("nll", F.array(F.lit(0.9), F.lit(0.95)))
    return nll.groupBy("doc_id").agg(
        n.alias("n_tokens"), ok(F.avg("nll")).alias("mean_surprisal"), ok(F.exp(F.avg("nll"))).alias("ppl"), ok(F.coalesce(F.stddev_samp("nll"), F.lit(0.0))).alias("std_surprisal"),
        ok(F.max("nll")).alias("max_surprisal"), ok(q[0]).alias("p90_surprisal"), ok(q[1]).alias("p95_surprisal"), ok(F.avg((F.col("nll") > threshold).cast("int"))).alias("frac_above"))


def sentiment(label: Column, positive: Column, negative: Column, neutral: Column) -> dict[str, Column]:
    return {"signed_polarity": F.round(positive - negative, 6), "affective_extremity": F.round(1 - neutral, 6), "is_subjective": (label != "neutral").cast("int")}


def unigram_nll(docs: DataFrame, id_col: str, text_col: str, window: int = 1024, stride: int = 512) -> DataFrame:
    """Token negative log-likelihoods under the corpus's own unigram model with add-one smoothing, for texts that no model has scored.

    window: the sliding window of the whole document in which the token is new, as in windows(); i counts within the sentence.
    """
    sents = F.split(F.trim(F.coalesce(F.col(text_col), F.lit(""))), r"(?<=[.!?])\s+")
    words = lambda s: F.regexp_extract_all(F.lower(s), F.lit(r"(\p{L}+)"), F.lit(1))
    listed = F.flatten(F.transform(sents, lambda s, k: F.transform(words(s), lambda w, i: F.struct(k.alias("sent"), i.alias("i"), w.alias("w")))))
    toks = cut(docs.select(F.col(id_col).alias("doc_id"), F.posexplode(listed).alias("at", "x")).select("doc_id", "at", "x.*"))  # read four times below
    counts = toks.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("v"))
    scored = counts.join(F.broadcast(total)).select("w", (-F.log((F.col("n") + 1) / (F.col("t") + F.col("v")))).alias("nll"))
    fresh = F.greatest(F.floor((F.col("at") - window) / stride) + 1, F.lit(0))
    return hot_join(toks, scored, "w").select("doc_id", "sent", fresh.alias("window"), "i", "nll")
