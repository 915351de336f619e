"""Features over a declared annotation table, so that any parser can feed them: (doc_id, sent, i, text, lemma, pos, dep, head_i, ent)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from korpusverk.functions.lexicons import SUBORDINATE
from korpusverk.plans.runtime import null_safe_join

ENTITIES = ("LOC", "PRS", "ORG", "TME", "WRK", "MSR", "OBJ", "EVN")
UPOS = ("ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "INTJ", "NOUN", "NUM", "PART", "PRON", "PROPN", "PUNCT", "SCONJ", "SYM", "VERB", "X")


@F.pandas_udf(IntegerType())
def tree_depth(i: pd.Series, head: pd.Series, dep: pd.Series) -> pd.Series:
    """Edges on the longest path from the first root of a sentence, by walking parents upwards."""

    def depth(nodes, heads, deps) -> int:
        up = dict(zip(nodes, heads))
        roots = [n for n, d in zip(nodes, deps) if d == "ROOT"]
        if not roots:
            return 0
        best = 0
        for n in nodes:
            steps, at = 0, n
            while at != roots[0] and steps <= len(up) and at in up and up[at] != at:
                at, steps = up[at], steps + 1
            best = max(best, steps if at == roots[0] else 0)
        return best

    return pd.Series([depth(a, b, c) for a, b, c in zip(i, head, dep)])


def syntactic(annotation: DataFrame) -> DataFrame:
    """dep_distance_mean (over the document), tree_depth_mean and _max, subordinate_clause_rate, n_sentences."""
    s = annotation.groupBy("doc_id", "sent").agg(
        F.array_sort(F.collect_list(F.struct("i", "head_i", "dep"))).alias("t"), F.sum(F.when(F.col("dep") != "ROOT", F.abs(F.col("i") - F.col("head_i")))).alias("far"),
        F.count_if(F.col("dep") != "ROOT").alias("inner"), F.count_if(F.col("dep").isin(*SUBORDINATE)).alias("sub"))  # a sentence: bounded by its length
    s = s.withColumn("depth", tree_depth(F.col("t.i"), F.col("t.head_i"), F.col("t.dep")))
    return s.groupBy("doc_id").agg(
        F.coalesce(F.sum("far") / F.nullif(F.sum("inner"), F.lit(0)), F.lit(0.0)).alias("dep_distance_mean"), F.avg("depth").alias("tree_depth_mean"), F.max("depth").alias("tree_depth_max"),
        (F.sum("sub") / F.count(F.lit(1))).alias("subordinate_clause_rate"), F.count(F.lit(1)).alias("n_sentences"))


def entity_rates(annotation: DataFrame) -> DataFrame:
    """ner_<TYPE>_rate per 100 tokens, and in total over all labels; comma tokens don't count as tokens."""
    n = F.count_if(F.col("text") != ",")
    rate = lambda c: F.when(n > 0, F.count_if(c) * 100.0 / n)
    return annotation.groupBy("doc_id").agg(*[rate(F.col("ent") == e).alias(f"ner_{e}_rate") for e in ENTITIES], rate(F.coalesce(F.col("ent"), F.lit("")) != "").alias("ner_total_rate"))


def pos_shares(annotation: DataFrame) -> DataFrame:
    return annotation.groupBy("doc_id").agg(*[(F.count_if(F.col("pos") == p) / F.count(F.lit(1))).alias(f"pos_{p}") for p in UPOS], F.count_if(~F.col("pos").isin("PUNCT", "SPACE")).alias("content_tokens"), F.count_distinct(F.lower("lemma")).alias("n_unique_lemmas"))


def top_relations(annotation: DataFrame, k: int = 12) -> DataFrame:
    """The k most frequent relations of each document as a JSON map, ties by name."""
    c = annotation.groupBy("doc_id", "dep").agg(F.count(F.lit(1)).alias("n"))
    packed = c.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "dep"))).alias("a"))  # as many as there are relation names
    return packed.select("doc_id", F.to_json(F.map_from_entries(F.transform(F.slice("a", 1, k), lambda e: F.struct(e["dep"].alias("key"), (-e["m"]).alias("value"))))).alias("top_relations"))


def inspection(annotation: DataFrame) -> DataFrame:
    """token/relation/head triples and text:label entities of each sentence, in order.

    Heads come by a sort-merge join: they are as many as the tokens, but the planner sees only the size of the texts that tokens are taken from, and would broadcast them all.
    """
    heads = annotation.select(F.col("doc_id").alias("_doc"), F.col("sent").alias("_sent"), F.col("i").alias("_i"), F.col("text").alias("head")).hint("merge")
    j = annotation.join(heads, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("sent") == F.col("_sent")) & (F.col("head_i") == F.col("_i")), "left")
    g = j.groupBy("doc_id", "sent").agg(F.array_sort(F.collect_list(F.struct("i", F.concat_ws("/", "text", "dep", "head").alias("s"), F.when(F.coalesce(F.col("ent"), F.lit("")) != "", F.concat_ws(":", "text", "ent")).alias("e")))).alias("a"))
    return g.select("doc_id", "sent", F.array_join("a.s", " | ").alias("dependencies"), F.array_join("a.e", " | ").alias("entities"))


TOKEN = r"(\p{L}+|\p{N}+|[^\s\p{L}\p{N}])"


def _sentences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.trim(F.coalesce(F.col(text_col), F.lit(""))), r"(?<=[.!?])\s+")).alias("sent", "s"))


def _rules(i: Column, text: Column) -> dict[str, Column]:
    """pos, dep, head_i and ent of the token that is number i of its sentence."""
    word = text.rlike(r"^\p{L}+$")
    name = (i > 0) & text.rlike(r"^\p{Lu}") & word
    return {
        "pos": F.when(name, "PROPN").when(word, "NOUN").when(text.rlike(r"^\p{N}+$"), "NUM").otherwise("PUNCT"),
        "dep": F.when(i == 0, "ROOT").when(F.lower(text).isin("som", "att"), "acl:relcl").otherwise("dep"), "head_i": F.greatest(i - 1, F.lit(0)), "ent": F.when(name, "LOC"),
    }


def from_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stand-in annotation by rule, for texts that no parser has seen: each token hangs on the one before it, capitalised inner words are entities."""
    toks = _sentences(docs, id_col, text_col).select("doc_id", "sent", F.posexplode(F.regexp_extract_all("s", F.lit(TOKEN), F.lit(1))).alias("i", "text"))
    rules = _rules(F.col("i"), F.col("text"))
    return toks.select("doc_id", "sent", "i", "text", F.lower("text").alias("lemma"), *[c.alias(k) for k, c in rules.items()])


def inspection_by_rule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """inspection(from_tokens(docs)), each sentence made where its text is read: no token is shuffled or joined.

    Only the texts of an id that several rows have are taken apart into tokens, as their sentences are put together by number.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("doc_id")
    some = not repeated.isEmpty()
    t = F.col("t")
    toks = _sentences(null_safe_join(docs, repeated, ["doc_id"], "left_anti") if some else docs, "doc_id", "_text").select("doc_id", "sent", F.regexp_extract_all("s", F.lit(TOKEN), F.lit(1)).alias("t")).filter(F.size("t") > 0)
    triple = lambda x, i: F.concat_ws("/", x, _rules(i, x)["dep"], F.get(t, _rules(i, x)["head_i"]))
    entity = lambda x, i: F.concat(x, F.lit(":"), _rules(i, x)["ent"])
    out = toks.select("doc_id", "sent", F.array_join(F.transform(t, triple), " | ").alias("dependencies"), F.array_join(F.transform(t, entity), " | ").alias("entities"))
    return out.unionByName(inspection(from_tokens(null_safe_join(docs, repeated, ["doc_id"], "left_semi"), "doc_id", "_text"))) if some else out
