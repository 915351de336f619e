"""Judge answers: parsing, correctness, summaries and paired contrasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusverk.operators.pairing import generator_pairs
from korpusverk.operators.stats import mcnemar_p, wilson

HUMAN, MACHINE, UNKNOWN = "MÄNNISKA", "AI", "UNKNOWN"


def verdict(text: Column) -> Column:
    up = F.upper(text)
    human = up.contains("MÄNNISKA") | up.contains("MANNISKA") | up.contains("HUMAN")
    return F.when(human, HUMAN).when(up.contains("AI"), MACHINE).otherwise(UNKNOWN)


def parse_response(raw: Column) -> Column:
    """STRUCT<predicted, confidence, reasoning> of a judge's answer.

    The outermost braces are cut out only where there is a code fence. JSON gives class, confidence (50 if absent) and 400 characters of
    reasoning; what is no JSON object, or has a confidence that is no number, is searched as text: 50 with a verdict, 0 without, 200 characters.
    """
    text = F.trim(F.coalesce(raw, F.lit("")))
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    text = F.when(text.contains("```") & (inner != ""), inner).otherwise(text)
    data = F.from_json(text, "classification string, confidence string, reasoning string", {"mode": "PERMISSIVE"})
    parsed = text.rlike(r"(?s)^\s*\{.*\}\s*$") & F.try_variant_get(F.try_parse_json(text), "$", "variant").isNotNull()
    number = F.coalesce(data["confidence"], F.lit("50"))
    whole = F.expr("1") * F.try_to_number(F.when(number.rlike(r"^-?\d{1,9}(\.\d+)?$"), F.regexp_extract(number, r"^(-?\d+)", 1)), F.lit("S999999999"))
    good = parsed & whole.isNotNull()
    found = verdict(text)
    return F.struct(
        F.when(good, verdict(F.coalesce(data["classification"], F.lit(UNKNOWN)))).otherwise(found).alias("predicted"),
        F.when(good, whole.cast("int")).otherwise(F.when(found == UNKNOWN, 0).otherwise(50)).alias("confidence"),
        F.when(good, F.substring(F.coalesce(data["reasoning"], F.lit("")), 1, 400)).otherwise(F.substring(text, 1, 200)).alias("reasoning"))


def correct(predicted: Column, is_human: Column) -> Column:
    """UNKNOWN is always wrong."""
    return (predicted != UNKNOWN) & ((predicted == HUMAN) == is_human)


def relabel(generator: Column, register: Column, condition: Column, is_human: Column) -> Column:
    return F.when(is_human, "human").when((generator == "gpt") & (register == "informal") & (condition == "baseline"), "gpt-4o-mini").when(generator == "gpt", "gpt-5.2").otherwise(generator)


def confusion(judged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """tp, fp, tn, fn with the machine as positive; UNKNOWN counts only in the accuracy's denominator."""
    n = lambda h, p: F.count_if((F.col("is_human") == h) & (F.col("predicted") == p))
    c = judged.groupBy(*keys).agg(n(False, MACHINE).alias("tp"), n(True, MACHINE).alias("fp"), n(True, HUMAN).alias("tn"), n(False, HUMAN).alias("fn"), F.count(F.lit(1)).alias("n"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    c = c.withColumn("precision", safe(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("accuracy", (F.col("tp") + F.col("tn")) / F.col("n"))


def recall_table(judged: DataFrame, dims: Sequence[str] = ("judge", "generator", "register", "condition")) -> DataFrame:
    """Recall with its Wilson interval per cell, with _ALL_ over conditions and _HEADLINE_ over registers and conditions."""
    view = judged.withColumn("_ok", F.col("correct").cast("int"))
    cells = view.groupingSets([[F.col(c) for c in dims[:k]] for k in (4, 3, 2)], *dims).agg(F.count(F.lit(1)).alias("n"), F.sum("_ok").alias("n_correct"), F.grouping(dims[2]).alias("_g2"), F.grouping(dims[3]).alias("_g3"))
    low, high = wilson(F.col("n_correct"), F.col("n"))
    return cells.select(
        dims[0], dims[1], F.when(F.col("_g2") == 1, "_HEADLINE_").otherwise(F.col(dims[2])).alias(dims[2]), F.when(F.col("_g3") == 1, "_ALL_").otherwise(F.col(dims[3])).alias(dims[3]),
        "n", "n_correct", (F.col("n_correct") / F.col("n")).alias("recall"), low.alias("wilson_lo"), high.alias("wilson_hi"))


def headline(judged: DataFrame) -> DataFrame:
    """Per judge and machine generator: accuracy, balanced accuracy and calibration; the human items are shared by all generators."""
    conf = lambda ok: F.avg(F.when(F.col("correct") == ok, F.col("confidence")))
    human = judged.filter("is_human").groupBy("judge").agg(F.count(F.lit(1)).alias("n_human"), F.sum(F.col("correct").cast("int")).alias("_hk"))
    machine = judged.filter("NOT is_human").groupBy("judge", "generator").agg(F.count(F.lit(1)).alias("n_ai"), F.sum(F.col("correct").cast("int")).alias("_ak"), conf(True).alias("conf_correct"), conf(False).alias("conf_wrong"))
    j = machine.join(human, "judge", "left").na.fill(0, ["n_human", "_hk"])
    hr, ar = F.col("_hk") / F.nullif(F.col("n_human"), F.lit(0)), F.col("_ak") / F.col("n_ai")
    gap = F.col("conf_correct") - F.col("conf_wrong")
    return j.select(
        "judge", "generator", (F.col("n_human") + F.col("n_ai")).alias("n"), (F.col("_hk") + F.col("_ak")).alias("n_correct"), "n_ai", "n_human", ((F.col("_hk") + F.col("_ak")) / (F.col("n_human") + F.col("n_ai"))).alias("overall_acc"),
        ((hr + ar) / 2).alias("balanced_acc"), hr.alias("human_recall"), ar.alias("ai_recall"), "conf_correct", "conf_wrong", F.when(gap > 2, "Calibrated").when(gap < -2, "Inverted").otherwise("Flat").alias("calibration"))


def contrasts(judged: DataFrame, keys: Sequence[str], by: str, unit: str = "pair_id") -> DataFrame:
    """Exact paired contrasts between any two values of by: (keys, a, b, n_pairs, b_only, c_only, recall_a, recall_b, delta, p_value)."""
    once = judged.groupBy(*keys, unit, by).agg(F.max(F.col("correct").cast("int")).alias("ok"))
    pairs = generator_pairs(once, [*keys, unit], by, "ok")
    cells = pairs.groupBy(*keys, "name_a", "name_b").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if((F.col("value_a") == 1) & (F.col("value_b") == 0)).alias("b"), F.count_if((F.col("value_a") == 0) & (F.col("value_b") == 1)).alias("c"),
        F.avg("value_a").alias("recall_a"), F.avg("value_b").alias("recall_b"))
    return cells.withColumn("delta", F.col("recall_b") - F.col("recall_a")).withColumn("p_value", mcnemar_p(F.col("b"), F.col("c"))).withColumn("method", F.when(F.col("b") + F.col("c") == 0, "no-discordance").otherwise("exact"))


def pooled(judged: DataFrame, keys: Sequence[str], subgroup: str) -> DataFrame:
    """Per subgroup n, accuracy, precision_human and recall_ai, and under _ALL_ their means weighted by n; a share without a base is null and left out of the sum."""
    base = lambda a, b: F.count_if(a) / F.nullif(F.count_if(b), F.lit(0))
    said, ai = F.col("predicted") == HUMAN, ~F.col("is_human")
    s = judged.groupBy(*keys, subgroup).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("int")).alias("accuracy"), base(said & ~ai, said).alias("precision_human"), base(ai & (F.col("predicted") == MACHINE), ai).alias("recall_ai"))
    whole = s.groupBy(*keys).agg(F.lit("_ALL_").alias(subgroup), F.sum("n").alias("N"), *[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c) for c in ("accuracy", "precision_human", "recall_ai")]).withColumnRenamed("N", "n")
    return s.unionByName(whole)


def report(df: DataFrame, keys: Sequence[str], truth: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """(keys, label, precision, recall, f1, support) of each label; 0 where there is no base."""
    t, p = F.col(truth), F.col(predicted)
    counts = df.groupBy(*keys).agg(*[F.struct(F.lit(x).alias("label"), F.count_if((t == x) & (p == x)).alias("tp"), F.count_if(p == x).alias("said"), F.count_if(t == x).alias("support")).alias(f"_{i}") for i, x in enumerate(labels)])
    c = counts.select(*keys, F.explode(F.array(*[F.col(f"_{i}") for i in range(len(labels))])).alias("c")).select(*keys, "c.*")
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    c = c.withColumn("precision", safe(F.col("tp"), F.col("said"))).withColumn("recall", safe(F.col("tp"), F.col("support")))
    return c.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select(*keys, "label", "precision", "recall", "f1", "support")
