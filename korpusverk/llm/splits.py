"""Splits that keep related records together.

Records are linked by group id and by title; components come from hooking and shortcutting, and a subset-sum over the multiplicities of
component sizes picks the split totals closest to the asked proportions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusverk.functions.keys import letters_and_digits
from korpusverk.llm.components import components
from korpusverk.operators.skew import hash62, hot_join, prefix_rank
from korpusverk.plans.runtime import clash_free, cut

#: Canonical forms of stand-ins for a missing title.
STAND_INS = ("", "nan", "null", "none", "na", "titelsaknas", "utantitel", "ingentitel", "okändtitel", "saknas", "saknartitel", "untitled", "notitle", "titel", "title", "xxx", "tbd")

#: Totals that the bitset tells apart; what is above it is filled with whole components from the largest down before.
BITS = 1 << 22


def title_key(title: Column) -> Column:
    """The canonical title; null where the title is null, blank or a stand-in."""
    key = letters_and_digits(title)
    return F.when(~key.isin(*STAND_INS), key)


def link_groups(records: DataFrame, group: str = "group_id", key: str = "link_key") -> DataFrame:
    """(node, root): components of groups that share a key. Records without a group link nothing, nor do those without a key.

    Each key is tied to its smallest group, so a key of a third of all rows costs one partial aggregate and a join that splits hot keys.
    """
    pairs = cut(clash_free(records, group, key).toDF("g", "k").filter("g IS NOT NULL").distinct())
    keyed = pairs.filter("k IS NOT NULL")
    low = keyed.groupBy("k").agg(F.min("g").alias("low"))
    return components(hot_join(keyed, low, "k").select("low", "g"), pairs, "low", "g", "g")


def subset(sizes: dict[int, int], target: int) -> dict[int, int]:
    """How many components of each size to take so that their total is closest to target, by bitsets over size multiplicities.

    Most of each size's share is taken outright; the bitset decides over the rest, with multiplicities as powers of two. It stops as soon as the
    target can be met; otherwise the nearest total is taken. For every total only the step that first reached it is kept, so memory
    is bounded by BITS, whatever the number of sizes.
    """
    total = sum(s * n for s, n in sizes.items())
    target = max(0, min(target, total))
    tries = []
    for outright in (True, False):  # where the shares taken outright leave no way to the target, the largest components go first
        taken = {s: max(0, int(n * target // total) - 2) if total and outright else 0 for s, n in sizes.items()}
        off = fill(sizes, taken, target - sum(s * t for s, t in taken.items()))
        tries.append((off, taken))
        if not off:
            break
    return min(tries, key=lambda t: t[0])[1]


def fill(sizes: dict[int, int], taken: dict[int, int], need: int) -> int:
    """Adds to taken what comes closest to need; returns how far off it stays."""
    left = {s: n - taken[s] for s, n in sorted(sizes.items(), reverse=True) if n > taken[s]}
    for s, n in left.items():  # from the largest down, until the bitset can tell the totals apart
        more = min(n, (need - BITS // 4) // s) if need > BITS // 2 else 0
        if more > 0:
            taken[s], left[s], need = taken[s] + more, n - more, need - more * s
    items = [(s, min(n, need // s + 1)) for s, n in left.items() if n and s <= 2 * need]
    ones = [(s, c) for s, n in items for c in powers(n)]
    limit = 2 * need + 1
    first = np.full(limit, -1, np.int32)
    first[0], at = len(ones), 1
    mask = (1 << limit) - 1
    for i, (s, c) in enumerate(ones):
        if first[need] >= 0:
            break
        new = (at << s * c) & mask & ~at
        if new:
            first[positions(new, limit)] = i
            at |= new
    reached = np.flatnonzero(first >= 0)
    best = int(reached[np.argmin(np.abs(reached - need))])
    off = abs(best - need)
    while best:
        s, c = ones[first[best]]
        best -= s * c
        taken[s] += c
    return off


def positions(bits: int, width: int) -> np.ndarray:
    raw = np.frombuffer(bits.to_bytes(-(-width // 8), "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")[:width])


def powers(n: int) -> list[int]:
    out, p = [], 1
    while n > 0:
        out.append(min(p, n))
        n -= out[-1]
        p *= 2
    return out


def quotas(sizes: dict[int, int], shares: Sequence[float]) -> list[dict[int, int]]:
    """Per split the number of components of each size; the first split takes what the others leave."""
    total, left, out = sum(s * n for s, n in sizes.items()), dict(sizes), []
    for share in list(shares)[:0:-1]:
        took = subset(left, round(total * share))
        left = {s: n - took.get(s, 0) for s, n in left.items()}
        out.insert(0, took)
    return [left, *out]


def assign_splits(members: DataFrame, names: Sequence[str] = ("train", "validation", "test"), shares: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 7) -> DataFrame:
    """(root, split) from members(root, weight): all of a root in one split.

    weight is the number of records; the histogram of sizes that goes to the driver has at most sqrt(2 x records) rows. Components of
    the same size are told apart by a seeded hash order. Null weights count as 0, roots without weight go into the first split, rows without a root are
    left out. An empty table gives an empty result.
    """
    rooted = clash_free(members, "root", "weight").filter("root IS NOT NULL")
    sized = cut(rooted.groupBy("root").agg(F.greatest(F.coalesce(F.sum("weight"), F.lit(0)), F.lit(0)).cast("bigint").alias("size")))
    spark = members.sparkSession
    histogram = {r["size"]: r["n"] for r in sized.filter("size > 0").groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    takes, rows = quotas(histogram, shares), []
    for size in histogram:
        at = 0
        for name, take in zip(names, takes):
            rows.append((size, name, at, at + take.get(size, 0)))
            at += take.get(size, 0)
    if not rows:
        return sized.select("root", F.lit(names[0]).alias("split"))
    plan = spark.createDataFrame(rows, "size bigint, split string, low bigint, high bigint").filter("high > low")
    ranked = prefix_rank(sized.filter("size > 0"), ["size"], hash62(F.lit(seed), "root"), "root")
    placed = hot_join(ranked, plan, "size").filter("_before >= low AND _before < high").select("root", "split")
    return placed.unionByName(sized.filter("size = 0").select("root", F.lit(names[0]).alias("split")))
