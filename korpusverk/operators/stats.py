"""Statistics over paired samples, distributions and judgements as grouped SQL; nothing is collected."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from korpusverk.plans.runtime import cut, null_safe_join

Z95 = 1.959963984540054


def erfc_approx(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26 for x >= 0; error below 1.5e-7."""
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal value."""
    return z.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2)))


#: Up to so many pairs without ties and zeros the signed-rank p-value is exact.
EXACT = 50


def signed_rank_p(stat: Column, n: Column) -> Column:
    """Exact two-sided p of the smaller rank sum among n ranks, by counting subsets of 1..n by their sum."""
    counts = F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.array(F.lit(1.0)), lambda c, k: F.transform(F.sequence(F.lit(0), F.size(c) + k - 1), lambda s: F.coalesce(F.get(c, s), F.lit(0.0)) + F.coalesce(F.get(c, s - k), F.lit(0.0))))
    tail = F.aggregate(F.slice(counts, F.lit(1), stat.cast("int") + 1), F.lit(0.0), lambda a, x: a + x)
    return F.least(2 * tail / F.pow(F.lit(2.0), n), F.lit(1.0))


def range_bucket(value: Column, per_octave: int = 64) -> Column:
    """A number that never falls as value rises: 64 steps for each doubling of its size. It cuts a sorted group into tasks without looking at the data."""
    size = F.floor(F.log2(F.greatest(F.abs(value), F.lit(1e-300))) * per_octave) + per_octave * 1000
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("bigint")


def cumulate(cells: DataFrame, keys: Sequence[str], value: str, weights: Sequence[str]) -> DataFrame:
    """Adds below_<w>: the sum of w over the key's smaller values. One row per key and value is asked for.

    Offsets of value ranges come from a small table, so that no task holds all values of a key.
    """
    ranged = cells.withColumn("_b", range_bucket(F.col(value)))
    sums = ranged.groupBy(*keys, "_b").agg(*[F.sum(w).alias(f"_s_{w}") for w in weights])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_b", *[F.coalesce(F.sum(f"_s_{w}").over(before), F.lit(0)).alias(f"_o_{w}") for w in weights])
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumns({f"_i_{w}": F.coalesce(F.sum(w).over(inside), F.lit(0)) for w in weights})
    joined = null_safe_join(within, offsets, [*keys, "_b"])
    return joined.withColumns({f"below_{w}": F.col(f"_i_{w}") + F.col(f"_o_{w}") for w in weights}).drop("_b", *[f"_{x}_{w}" for x in "io" for w in weights])


def paired_tests(pairs: DataFrame, keys: Sequence[str], human: str = "human", llm: str = "llm", exact_p: bool = True) -> DataFrame:
    """Per key: n_pairs, medians, cohens_dz, rank_biserial, wilcoxon_stat, p_value, direction.

    Differences are llm - human over pairs with both numbers; fewer than three pairs give no row. Zero differences count in n_pairs but
    not in the signed ranks; if all are zero, p is 1 and the effects are 0. The p-value is exact for up to 50 pairs without ties and zeros, else the normal approximation with tie correction
    (exact_p: by the error function, otherwise by a rational approximation of it that SQL can express).
    Medians and ranks follow from the counts of distinct values and their running sums, so a key of any size is spread over tasks.
    """
    kinds = F.array(*_kinds(F.col(human), F.col(llm)))
    return _tests(pairs.select(*keys, F.explode(kinds).alias("x")).select(*keys, "x.*"), keys, exact_p)


def paired_tests_wide(wide: DataFrame, keys: Sequence[str], pairs: dict[str, tuple[Column, Column]], exact_p: bool = True) -> DataFrame:
    """paired_tests of several features that stand side by side, by keys and feature: each row is taken apart once."""
    kinds = [k.withField("feature", F.lit(name)) for name, (h, l) in pairs.items() for k in _kinds(h, l)]
    return _tests(wide.select(*keys, F.explode(F.array(*kinds)).alias("x")).select(*keys, "x.*"), ["feature", *keys], exact_p)


def _kinds(human: Column, llm: Column) -> list[Column]:
    """What counts of a pair: both values, and the size of their difference with its sign; all null where a value is missing."""
    h, l = human.cast("double"), llm.cast("double")
    ok = h.isNotNull() & l.isNotNull() & ~F.isnan(h) & ~F.isnan(l)
    d = F.round(l - h, 12)
    return [F.struct(F.lit(k).alias("kind"), F.when(ok, v).alias("v"), up.alias("up")) for k, v, up in (("h", h, F.lit(0)), ("l", l, F.lit(0)), ("d", F.abs(d), (d > 0).cast("int")))]


def _tests(values: DataFrame, keys: Sequence[str], exact_p: bool) -> DataFrame:
    """The tests from (keys, kind, v, up), counted by distinct values first."""
    some = values.filter("v IS NOT NULL AND (kind <> 'd' OR v <> 0)")
    cells = cut(some.groupBy(*keys, "kind", "v").agg(F.count(F.lit(1)).alias("t"), F.sum("up").alias("up")))  # read three times below
    totals = cells.filter("kind = 'h'").groupBy(*keys).agg(F.sum("t").alias("_all"))
    ranked = null_safe_join(cumulate(cells, [*keys, "kind"], "v", ["t"]), totals, keys)
    middle = lambda k, at: F.max(F.when((F.col("kind") == k) & (F.col("below_t") <= at) & (F.col("below_t") + F.col("t") > at), F.col("v")))
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    signed, rank = F.col("kind") == "d", F.col("below_t") + (F.col("t") + 1) / 2.0
    out = ranked.groupBy(*keys).agg(
        F.max("_all").alias("n_pairs"), ((middle("h", low) + middle("h", high)) / 2).alias("median_human"), ((middle("l", low) + middle("l", high)) / 2).alias("median_llm"),
        F.sum(F.when(signed, rank * F.col("up"))).alias("w_up"), F.sum(F.when(signed, rank * (F.col("t") - F.col("up")))).alias("w_down"),
        F.sum(F.when(signed, F.col("v") * (2 * F.col("up") - F.col("t")))).alias("_d"), F.sum(F.when(signed, F.col("v") * F.col("v") * F.col("t"))).alias("_dd"), F.sum(F.when(signed, F.col("t"))).alias("_n"), F.sum(F.when(signed, F.pow("t", F.lit(3)) - F.col("t"))).alias("_ties"))
    out = out.filter("n_pairs >= 3")
    mean = F.col("_d") / F.col("n_pairs")
    spread = (F.col("_dd") - F.col("_d") * mean) / (F.col("n_pairs") - 1)
    sd = F.when(spread > 1e-13 * F.col("_dd") / F.col("n_pairs"), F.sqrt(spread))  # what rounding leaves of equal differences is no spread
    n, stat = F.col("_n").cast("double"), F.least("w_up", "w_down")
    z = (stat - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    p = normal_p(z) if exact_p else erfc_approx(F.abs(z) / math.sqrt(2))
    few = (F.col("_n") <= EXACT) & (F.col("_ties") == 0) & (F.col("_n") == F.col("n_pairs"))
    p = F.when(few, signed_rank_p(stat, F.when(few, F.col("_n")).otherwise(1))).otherwise(p)
    return out.select(
        *keys, "n_pairs", "median_human", "median_llm", F.when(F.col("median_llm") > F.col("median_human"), "llm > human").when(F.col("median_llm") < F.col("median_human"), "llm < human").otherwise("equal").alias("direction"),
        F.when(F.col("_n").isNull(), F.lit(0.0)).otherwise(mean / sd).alias("cohens_dz"),
        F.coalesce((F.col("w_up") - F.col("w_down")) / (F.col("w_up") + F.col("w_down")), F.lit(0.0)).alias("rank_biserial"),
        F.coalesce(stat, F.lit(0.0)).alias("wilcoxon_stat"), F.when(F.col("_n").isNull(), F.lit(1.0)).otherwise(p).alias("p_value"))


def fdr(tests: DataFrame, family: Sequence[str], p: str = "p_value", level: float = 0.05) -> DataFrame:
    """Adds p_fdr_bh (Benjamini-Hochberg within the family) and significant. Ties in p are broken by nothing: they get the same q.

    A family is one task: it holds a row for each test, features times conditions, not for each pair.
    """
    m = F.count(p).over(Window.partitionBy(*family))
    rank = F.rank().over(Window.partitionBy(*family).orderBy(p)) + F.count(F.lit(1)).over(Window.partitionBy(*family, p)) - 1
    raw = tests.withColumn("_q", F.col(p) * m / rank)
    q = F.least(F.min("_q").over(Window.partitionBy(*family).orderBy(p).rangeBetween(Window.currentRow, Window.unboundedFollowing)), F.lit(1.0))
    return raw.withColumn("p_fdr_bh", q).withColumn("significant", F.col("p_fdr_bh") < level).drop("_q")


def effect_band(effect: Column) -> Column:
    e = F.abs(effect)
    return F.when(e >= 0.8, "large").when(e >= 0.5, "medium").when(e >= 0.2, "small").otherwise("negligible")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def jensen_shannon(counts: DataFrame, keys: Sequence[str], label: str, side: str = "side", n: str = "n", sides: tuple[str, str] = ("human", "llm")) -> DataFrame:
    """Per key js_divergence (base 2), js_distance (its root) and the totals; null where a side has nothing."""
    a = F.sum(F.when(F.col(side) == sides[0], F.col(n)).otherwise(0)).alias("a")
    b = F.sum(F.when(F.col(side) == sides[1], F.col(n)).otherwise(0)).alias("b")
    cells = counts.groupBy(*keys, label).agg(a, b)
    totals = cells.groupBy(*keys).agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    shares = cells.join(totals, list(keys)).withColumn("p", F.try_divide("a", "ta")).withColumn("q", F.try_divide("b", "tb")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / F.col("m"))).otherwise(0.0)
    js = F.when((F.first("ta") > 0) & (F.first("tb") > 0), F.greatest(F.sum(0.5 * part("p") + 0.5 * part("q")), F.lit(0.0)))
    out = shares.groupBy(*keys).agg(js.alias("js_divergence"), F.max("ta").alias("human_total"), F.max("tb").alias("llm_total"))
    return out.withColumn("js_distance", F.sqrt("js_divergence"))


def wasserstein(values: DataFrame, keys: Sequence[str], side: str = "side", value: str = "value", sides: tuple[str, str] = ("human", "llm")) -> DataFrame:
    """Per key the first Wasserstein distance of the two sides' values; nulls are left out of each side on its own."""
    cells = values.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(*[F.sum((F.col(side) == s).cast("bigint")).alias(x) for s, x in zip(sides, "ab")])
    totals = cells.groupBy(*keys).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    run = null_safe_join(cumulate(cells, keys, "v", ["a", "b"]), totals, keys)
    share = lambda a, b: F.abs(F.try_divide(a, F.col("na")) - F.try_divide(b, F.col("nb")))
    before, after = share(F.col("below_a"), F.col("below_b")), share(F.col("below_a") + F.col("a"), F.col("below_b") + F.col("b"))
    # the area between two steps, summed by parts: no look at the next value is needed
    return run.groupBy(*keys).agg(F.coalesce(F.sum(F.col("v") * (before - after)), F.lit(0.0)).alias("wasserstein"))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """The Wilson interval of k of n, within [0, 1]; null where n is 0."""
    p = k / n
    mid, half, base = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    ok = n > 0
    return F.when(ok, F.greatest((mid - half) / base, F.lit(0.0))), F.when(ok, F.least((mid + half) / base, F.lit(1.0)))


#: The exact tail is summed term by term; its length must not grow with the data.
EXACT_PAIRS = 100_000


def mcnemar_p(b: Column, c: Column) -> Column:
    """Two-sided p of b against c discordant pairs; 1 where there are none. Exact up to EXACT_PAIRS of them, beyond the normal approximation, which differs there by less than 1e-5."""
    n, low = b + c, F.least(b, c)
    many = n > EXACT_PAIRS
    low = F.when(many, 0).otherwise(low)
    tail = F.aggregate(
        F.sequence(F.lit(0), low.cast("int")), F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("t")),
        lambda a, k: F.struct((a["s"] + F.exp(F.when(k == 0, F.lit(0.0)).otherwise(a["t"] + F.log((n - k + 1).cast("double")) - F.log(F.greatest(k, F.lit(1)).cast("double"))) - n * math.log(2))).alias("s"),
                              F.when(k == 0, F.lit(0.0)).otherwise(a["t"] + F.log((n - k + 1).cast("double")) - F.log(F.greatest(k, F.lit(1)).cast("double"))).alias("t")))
    near = F.least(erfc_approx((F.abs(b - c) - 1) / F.sqrt(2.0 * n)), F.lit(1.0))
    return F.when(n == 0, F.lit(1.0)).when(many, near).otherwise(F.least(2 * tail["s"], F.lit(1.0)))


def hanley_mcneil(auc: Column, positives: Column, negatives: Column, z: float = 1.96) -> tuple[Column, Column]:
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    var = (auc * (1 - auc) + (positives - 1) * (q1 - auc * auc) + (negatives - 1) * (q2 - auc * auc)) / (positives * negatives)
    se = F.sqrt(F.greatest(var, F.lit(0.0)))
    return F.greatest(auc - z * se, F.lit(0.0)), F.least(auc + z * se, F.lit(1.0))


def auc(scores: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve from average ranks of distinct scores: (keys, auc, positives, negatives)."""
    cells = scores.groupBy(*keys, F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("t"), F.sum((F.col(label) == 1).cast("bigint")).alias("pos"))
    ranked = cumulate(cells.withColumn("s", F.col("s").cast("double")), keys, "s", ["t"])
    sums = ranked.withColumn("r", F.col("below_t") + (F.col("t") + 1) / 2.0).groupBy(*keys).agg(F.sum(F.col("r") * F.col("pos")).alias("rs"), F.sum("pos").alias("positives"), (F.sum("t") - F.sum("pos")).alias("negatives"))
    p, n = F.col("positives").cast("double"), F.col("negatives").cast("double")
    return sums.select(*keys, F.when((p > 0) & (n > 0), (F.col("rs") - p * (p + 1) / 2) / (p * n)).alias("auc"), "positives", "negatives")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i.cast("double") * j.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def quantiles(values: DataFrame, keys: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """Per key the exact, linearly interpolated quantiles at the asked places, from counts of distinct values and their running sums; no task holds a whole key.

    Nulls are left out; a key without any value has no row.
    """
    cells = cut(values.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("t")))
    totals = cells.groupBy(*keys).agg(F.sum("t").alias("_n"))
    run = null_safe_join(cumulate(cells, keys, "_v", ["t"]), totals, keys)
    held = lambda k: F.max(F.when((F.col("below_t") <= k) & (F.col("below_t") + F.col("t") > k), F.col("_v")))
    out = []
    for name, q in at.items():
        place = (F.col("_n") - 1) * F.lit(float(q))
        low = held(F.floor(place))
        out.append((low + (held(F.ceil(place)) - low) * F.max(place - F.floor(place))).alias(name))
    return run.groupBy(*keys).agg(*out)


def box(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return quantiles(df, keys, value, {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0})
