"""Duplicates, components and splits against brute force."""

import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from korpusverk.llm.components import components
from korpusverk.llm.duplicates import collapse_duplicates, duplicate_members, duplicate_rows, keyed_rows, sets_of
from korpusverk.llm.splits import assign_splits, link_groups, quotas, subset, title_key
from pyspark.sql import functions as F


def canonical(x):
    return "".join(c for c in (x or "").lower() if c.isalnum())


def members_by_hand(rows):
    sets = defaultdict(list)
    for i, a, b in rows:
        a, b = canonical(a), canonical(b)
        if a and b:
            sets[tuple(sorted((a, b)))].append(i)
    return {(i, min(v), len(v)) for v in sets.values() for i in v}


def test_duplicates_by_hand(spark):
    rows = [(1, "Hej du", "ja!"), (2, "HEJ  du.", "Ja"), (3, "ja", "hej-du"), (4, None, "ja"), (5, "", "ja"), (6, "...", "ja"), (7, "annat", "nej"), (8, "x" * 200_000, "y"), (9, "X" * 200_000 + "!", "Y")]
    df = spark.createDataFrame(rows, "id bigint, q string, h string")
    got = {tuple(r) for r in duplicate_members(df, "id", ["q", "h"]).collect()}
    assert got == members_by_hand(rows)
    kept = {tuple(r) for r in collapse_duplicates(df, "id", ["q", "h"]).collect()}
    assert kept == {(1, 3), (4, 1), (5, 1), (6, 1), (7, 1), (8, 2)}


def test_duplicates_hot_key_takes_the_salted_way(spark):
    """One set with half of the rows, a hot key, beside pairs."""
    rows = [(i, "Het fråga" + "!" * (i % 3), "svar") for i in range(3000)] + [(i, f"fråga {i // 2}", "svar") for i in range(3000, 6000)]
    df = spark.createDataFrame(rows, "id bigint, q string, h string").repartition(7)
    plan = sets_of(keyed_rows(df, "id", ["q", "h"]))
    assert plan.filter("_copies >= 512").count() == 1 and "_salt" in plan._jdf.queryExecution().toString()
    got = {tuple(r) for r in duplicate_members(df, "id", ["q", "h"]).collect()}
    assert got == members_by_hand(rows)
    assert {tuple(r) for r in duplicate_rows(df, "id", ["q", "h"]).collect()} == {(i, f) for i, f, _ in got if i != f}


def test_duplicates_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "id bigint, q string, h string")
    assert duplicate_members(df, "id", ["q", "h"]).count() == 0
    named = spark.createDataFrame([(1, "a", "b", 9, "z"), (2, "A", "b.", 9, "z")], "id bigint, q string, h string, ID bigint, _key string")
    assert {r["id"] for r in duplicate_members(named, "id", ["q", "h"]).collect()} == {1, 2}


def union_find(nodes, edges):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            up.setdefault(a, a)
            up.setdefault(b, b)
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    return {(n, root(n)) for n in nodes}


def test_components_random_chain_and_star(spark):
    rng = random.Random(3)
    nodes = [f"n{i:03d}" for i in range(160)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(90)] + [(nodes[i], nodes[i + 1]) for i in range(100, 125)] + [("n000", n) for n in nodes[60:80]] + [(None, "n001"), ("n002", "n002")]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a string, b string"), spark.createDataFrame([(n,) for n in nodes], "node string")).collect()}
    assert got == union_find(nodes, edges)


def test_components_with_a_third_of_the_rows_on_one_node(spark):
    nodes = [f"n{i:05d}" for i in range(3000)]
    edges = [("n00000", n) for n in nodes[1:1001]] + [(nodes[i], nodes[i + 1]) for i in range(1500, 1540)] + [(nodes[i], nodes[i + 1]) for i in range(2000, 3000, 2) if i < 2999]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a string, b string"), spark.createDataFrame([(n,) for n in nodes], "node string")).collect()}
    assert got == union_find(nodes, edges)


def test_components_without_edges(spark):
    got = components(spark.createDataFrame([], "a string, b string"), spark.createDataFrame([("x",), (None,), ("x",)], "node string"))
    assert [tuple(r) for r in got.collect()] == [("x", "x")]


def test_link_groups_null_and_stand_in_keys(spark):
    rows = [("a", "k1"), ("b", "k1"), ("c", None), ("d", None), (None, "k1"), ("b", "k2"), ("e", "k2")]
    got = dict(tuple(r) for r in link_groups(spark.createDataFrame(rows, "group_id string, link_key string")).collect())
    assert got == {"a": "a", "b": "a", "e": "a", "c": "c", "d": "d"}
    titles = spark.createDataFrame([("Titel saknas",), ("-",), (None,), ("  Ett Namn!",)], "t string").select(title_key(F.col("t")).alias("k"))
    assert [r["k"] for r in titles.collect()] == [None, None, None, "ettnamn"]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), min_size=1, max_size=7), st.floats(0, 1))
def test_subset_is_close(sizes, share):
    total = sum(s * n for s, n in sizes.items())
    target = round(total * share)
    took = subset(sizes, target)
    assert all(0 <= took.get(s, 0) <= n for s, n in sizes.items())
    assert abs(sum(s * t for s, t in took.items()) - target) <= max(sizes)


def test_quotas_take_all_once():
    sizes = {1: 1000, 3: 50, 400: 1}
    parts = quotas(sizes, (0.8, 0.1, 0.1))
    assert {s: sum(p.get(s, 0) for p in parts) for s in sizes} == sizes
    assert [sum(s * n for s, n in p.items()) for p in parts][1:] == [155, 155]


def test_assign_splits_keeps_groups_whole(spark):
    rows = [(f"r{i:04d}", 1 + (i % 7 == 0) * 4) for i in range(700)]
    out = assign_splits(spark.createDataFrame(rows, "root string, weight bigint")).collect()
    assert len(out) == 700
    weight = dict(rows)
    total = sum(weight.values())
    by = defaultdict(int)
    for r in out:
        by[r["split"]] += weight[r["root"]]
    assert abs(by["test"] - total * 0.1) <= 1 and abs(by["validation"] - total * 0.1) <= 1
    assert assign_splits(spark.createDataFrame([], "root string, weight bigint")).count() == 0


def test_splits_with_nulls_zeros_and_clashing_names(spark):
    rows = [("a", 3, 0), ("a", None, 0), ("b", None, 0), ("c", 0, 0), (None, 5, 0), ("d", 2, 0)]
    df = spark.createDataFrame(rows, "root string, weight bigint, ROOT bigint")
    got = {r["root"]: r["split"] for r in assign_splits(df, ("x", "y"), (0.6, 0.4)).collect()}
    assert got == {"a": "x", "d": "y", "b": "x", "c": "x"}
    linked = spark.createDataFrame([("a", "k", 1), ("b", "k", 2), (None, "k", 3), ("c", None, 4)], "group_id string, link_key string, Group_Id int")
    assert dict(tuple(r) for r in link_groups(linked).collect()) == {"a": "a", "b": "a", "c": "c"}
    assert link_groups(linked.limit(0)).count() == 0


def test_subset_of_many_and_large_sizes():
    """Thousands of sizes, and one component with a third of all: the total is met exactly, in bounded memory."""
    sizes = {s: 1 for s in range(1, 2001)}
    assert sum(s * t for s, t in subset(sizes, 200_100).items()) == 200_100
    huge = {30_000_000: 1, 7: 5_000_000, 1: 25_000_000}
    for share in (0.1, 0.5, 0.9):
        target = round(sum(s * n for s, n in huge.items()) * share)
        took = subset(huge, target)
        assert sum(s * t for s, t in took.items()) == target and all(took[s] <= n for s, n in huge.items())


def test_queries_agree_with_their_sql(spark, sf):
    import glob
    import os

    import duckdb

    from korpusverk.llm import grouping

    con = duckdb.connect()
    for f in glob.glob(sf.replace("0.001", "0.01") + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    for name, sql in grouping.oracle_sql().items():
        got, want = grouping.queries()[name](spark, sf.replace("0.001", "0.01")).toPandas(), con.execute(sql).df()
        assert sorted(map(tuple, got[sorted(got.columns)].values)) == sorted(map(tuple, want[sorted(want.columns)].values)), name
