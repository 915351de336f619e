"""Mixing sources to target weights.

Method: a low-discrepancy schedule. The points of the golden-ratio sequence, mapped through the cumulative weights, give each slot its source; slots are
ranked per source, and each source's documents, shuffled by hash and laid end to end, lap after lap, fill blocks of equal token count that are
joined to the slots of the same rank. A document's position is its first token's place in the mix: its slot's start and its place in the block.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korpusverk.llm.tokens import count_tokens
from korpusverk.operators.skew import hash62, prefix_rank
from korpusverk.plans.runtime import clash_free, cut

SLOTS = 1 << 16
#: Tokens of a block at least: small corpora have fewer slots.
BLOCK = 128
GOLDEN = (math.sqrt(5) - 1) / 2


def schedule(spark, weights: list[tuple[str, float]], slots: int = SLOTS) -> DataFrame:
    """(position, source, rank): rank counts the earlier slots of the same source. The table has slots rows, whatever the corpus."""
    total = sum(w for _, w in weights)
    point = (F.col("id") * F.lit(GOLDEN) + F.lit(0.5)) % F.lit(1.0)
    chosen, at = None, 0.0
    for name, w in weights:
        at += w / total
        chosen = F.when(point < at, name) if chosen is None else chosen.when(point < at, name)
    named = spark.range(slots).select(F.col("id").alias("position"), chosen.otherwise(weights[-1][0]).alias("source"))
    return named.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("position")) - 1)


def largest(held: dict, wanted: list[tuple[str, float, int]]) -> int:
    """The most tokens at which every source that has any reaches its share of them with its repeats."""
    able = [(held[s][0] * m, w) for s, w, m in wanted if s in held and w > 0 and m > 0]
    total = sum(w for _, w in able)
    return int(min((t * total / w for t, w in able), default=0))


def mix(docs: DataFrame, targets: DataFrame, path: str | None = None, budget: int | None = None, slots: int = SLOTS, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares) from docs(doc_id, text, source) and targets(source, target_share, max_repeats).

    chosen: doc_id, source, n_tokens, repeats, positions (one for each repeat, ascending; no two uses share one). shares: one row per target
    with its documents, tokens and actual share. budget: tokens to mix, by default the most at which every source with documents keeps its share
    (shares are taken among those sources). With a larger budget a source too small even with all repeats gives what it has, and the report
    shows it. A source without documents, or with a null or non-positive target or max_repeats, has share 0; documents with a null or
    untargeted source or without a token are never chosen. A source's last document may overrun its share.
    """
    spark = docs.sparkSession
    wanted = [(r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in clash_free(targets, "source", "target_share", "max_repeats").orderBy("source").collect() if r["source"] is not None]  # a settings table
    sized = cut(count_tokens(docs, "doc_id", "text", "source", path=path).filter("n_tokens > 0 AND source IS NOT NULL"))
    held = {r["source"]: (r["t"], r["n"]) for r in sized.filter(F.col("source").isin([s for s, _, _ in wanted])).groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    able = [(s, w, m) for s, w, m in wanted if s in held and w > 0 and m > 0]
    total = largest(held, wanted) if budget is None else budget
    if not able or total <= 0:
        chosen = spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint, repeats bigint, positions array<bigint>")
    else:
        slots = max(1, min(slots, total // BLOCK))
        block = max(1, total // slots)
        plan = cut(schedule(spark, [(s, w) for s, w, _ in able], slots + slots // 32 + 64))  # spare slots, as a source may get a few less than its share
        whole = sum(w for _, w, _ in able)
        due = {s: round(total * w / whole) for s, w, _ in able}
        rows = [(s, min(m, math.ceil(due[s] / held[s][0])), held[s][0], due[s]) for s, w, m in able]
        rounds = spark.createDataFrame(rows, "source string, rounds int, held bigint, due bigint").filter("rounds > 0")
        laps = sized.join(F.broadcast(rounds), "source").withColumn("lap", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
        n = sum(held[s][1] * k for s, k, _, _ in rows)
        placed = prefix_rank(laps, ["source", "lap"], hash62(F.lit(seed), "lap", "doc_id"), "doc_id", F.col("n_tokens"), rows=n)
        start = (F.col("_before") + F.col("lap") * F.col("held")).cast("bigint")
        placed = placed.withColumn("start", start).withColumn("rank", F.expr(f"start div {block}")).filter("start < due")
        joined = placed.join(F.broadcast(plan), ["source", "rank"])  # slots rows
        place = F.col("position") * F.lit(block) + F.col("start") % F.lit(block)
        chosen = joined.groupBy("doc_id", "source", "n_tokens").agg(F.count(F.lit(1)).alias("repeats"), F.array_sort(F.collect_list(place.cast("bigint"))).alias("positions"))  # max_repeats places
    got = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    asked = spark.createDataFrame(wanted, "source string, target_share double, max_repeats int")
    merged = asked.join(got, "source", "left").na.fill(0, ["documents", "tokens", "most_repeats"])
    whole = Window.partitionBy(F.lit(1))  # one row per target
    shares = merged.withColumn("actual_share", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(whole), F.lit(0)), F.lit(0.0)))
    return chosen, shares
