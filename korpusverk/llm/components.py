"""Connected components by parallel hooking and shortcutting over parent tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusverk.operators.skew import hot_join
from korpusverk.plans.runtime import cut


def shortcut(parent: DataFrame) -> DataFrame:
    """parent(node, up) with every up replaced by its root; up <= node holds, so the pointers end at fixed points."""
    while True:
        top = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumped = cut(hot_join(parent, top, "up", "left").select("node", "up", F.coalesce("top", "up").alias("new")))
        moved = jumped.filter(F.col("new") != F.col("up")).limit(1).count()
        parent = jumped.select("node", F.col("new").alias("up"))
        if not moved:
            return parent


def components(edges: DataFrame, nodes: DataFrame, left: str = "a", right: str = "b", node: str = "node") -> DataFrame:
    """(node, root): the smallest node of each node's component.

    Each round hooks every node on its smallest neighbour, shortcuts the pointers to roots and carries the edges over to roots; at least
    half of the nodes that still have an edge lose their place as roots, so the number of rounds is logarithmic. Nulls link nothing;
    nodes without an edge are their own root; self-loops and repeated edges are harmless. All joins split hot keys, so the centre of a star and
    the root of a component may hold any share of the rows.
    """
    e = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    e = cut(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    assigned = nodes.select(F.col(node).alias("node")).filter("node IS NOT NULL").distinct().withColumn("root", F.col("node"))
    while e.limit(1).count():
        low = e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        ends = e.select(F.col("a").alias("node")).distinct().withColumn("up", F.col("node"))
        hooked = low.unionByName(ends).groupBy("node").agg(F.min("up").alias("up"))
        flat = shortcut(cut(hooked))
        to = flat.select(F.col("node").alias("root"), F.col("up").alias("new"))
        assigned = cut(hot_join(assigned, to, "root", "left").select("node", F.coalesce("new", "root").alias("root")))
        a = flat.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        b = flat.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        e = hot_join(hot_join(e, a, "a"), b, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        e = cut(e.distinct())
    return assigned
