"""Formulas against published constants and properties."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from korpusverk.operators import annotations as N
from korpusverk.operators import language_model as L
from korpusverk.operators import pairing as P
from korpusverk.operators import sampling as S
from korpusverk.operators import scoring as J
from korpusverk.operators import stats as A


@pytest.mark.parametrize(("k", "n", "low", "high"), [(94, 100, 0.8752318455410406, 0.9722138760368118), (0, 100, 0.0, 0.0369935)])
def test_wilson(spark, k, n, low, high):
    got = spark.createDataFrame([(k, n)], "k bigint, n bigint").select(*A.wilson(F.col("k"), F.col("n"))).first()
    assert got[0] == pytest.approx(low, abs=1e-9) and got[1] == pytest.approx(high, abs=1e-6)


def test_wilson_of_nothing(spark):
    assert spark.createDataFrame([(0, 0)], "k bigint, n bigint").select(*A.wilson(F.col("k"), F.col("n"))).first()[0] is None


@pytest.mark.parametrize(("b", "c", "p"), [(29, 4, 1.0928604751825333e-05), (33, 3, 2.2721360437572002e-07), (15, 5, 0.04138946533203125), (0, 0, 1.0), (3, 3, 1.0)])
def test_mcnemar(spark, b, c, p):
    assert spark.createDataFrame([(b, c)], "b bigint, c bigint").select(A.mcnemar_p(F.col("b"), F.col("c"))).first()[0] == pytest.approx(p, rel=1e-9)


@pytest.mark.parametrize(("auc", "low", "high"), [(0.643, 0.5668, 0.7192), (0.935, 0.8992, 0.9708)])
def test_hanley(spark, auc, low, high):
    got = spark.createDataFrame([(auc,)], "a double").select(*A.hanley_mcneil(F.col("a"), F.lit(100.0), F.lit(100.0))).first()
    assert got[0] == pytest.approx(low, abs=5e-5) and got[1] == pytest.approx(high, abs=5e-5)


def test_paired_tests_edges(spark):
    rows = [("same", 1.0, 1.0)] * 4 + [("two", 1.0, 2.0)] * 2 + [("up", float(i), float(i) + 1 + i % 2) for i in range(10)] + [("up", None, 3.0), ("up", float("nan"), 3.0)] + [("const", float(i), float(i) + 1) for i in range(5)]
    got = {r["k"]: r for r in A.paired_tests(spark.createDataFrame(rows, "k string, human double, llm double"), ["k"]).collect()}
    assert set(got) == {"same", "up", "const"}
    assert got["same"]["p_value"] == 1 and got["same"]["cohens_dz"] == 0 and got["same"]["rank_biserial"] == 0
    assert got["up"]["n_pairs"] == 10 and got["up"]["rank_biserial"] == 1 and got["up"]["wilcoxon_stat"] == 0
    assert got["up"]["cohens_dz"] == pytest.approx(1.5 / 0.5270462766947299)
    assert got["const"]["cohens_dz"] is None


def test_effects_turn_with_the_sides(spark):
    df = spark.createDataFrame([("k", float(i % 5), float((i * 7) % 11)) for i in range(40)], "k string, human double, llm double")
    a = A.paired_tests(df, ["k"]).first()
    b = A.paired_tests(df.select("k", F.col("llm").alias("human"), F.col("human").alias("llm")), ["k"]).first()
    assert a["cohens_dz"] == pytest.approx(-b["cohens_dz"]) and a["rank_biserial"] == pytest.approx(-b["rank_biserial"]) and a["p_value"] == pytest.approx(b["p_value"])


def test_fdr_is_monotone(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.8, 0.03]
    got = [tuple(r) for r in A.fdr(spark.createDataFrame([("f", x) for x in p], "f string, p_value double"), ["f"]).orderBy("p_value").select("p_value", "p_fdr_bh").collect()]
    assert [round(q, 6) for _, q in got] == [0.03, 0.03, 0.045, 0.045, 0.048, 0.8]


def test_distances(spark):
    c = spark.createDataFrame([("x", "a", "human", 3), ("x", "b", "llm", 5), ("y", "a", "human", 2), ("y", "a", "llm", 7), ("z", "a", "human", 2)], "k string, l string, side string, n bigint")
    got = {r["k"]: r for r in A.jensen_shannon(c, ["k"], "l").collect()}
    assert got["x"]["js_distance"] == pytest.approx(1) and got["y"]["js_distance"] == pytest.approx(0) and got["z"]["js_distance"] is None
    w = spark.createDataFrame([("x", "human", 0.0), ("x", "human", 1.0), ("x", "llm", 5.0), ("x", "llm", 6.0), ("x", "llm", None)], "k string, side string, value double")
    assert A.wasserstein(w, ["k"]).first()["wasserstein"] == pytest.approx(5)


def test_auc_with_ties(spark):
    df = spark.createDataFrame([("g", 0.1, 0), ("g", 0.4, 1), ("g", 0.4, 0), ("g", 0.9, 1), ("h", 0.5, 1)], "g string, s double, y int")
    got = {r["g"]: r["auc"] for r in A.auc(df, ["g"], "s", "y").collect()}
    assert got == {"g": pytest.approx(0.875), "h": None}


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"classification": "Människa", "confidence": 80, "reasoning": "x"}', ("MÄNNISKA", 80, "x")), ('text ```json\n{"classification": "AI"}\n``` mer', ("AI", 50, "")), ("Jag tror HUMAN", ("MÄNNISKA", 50, "Jag tror HUMAN")),
        ("En AI skrev", ("AI", 50, "En AI skrev")), ("", ("UNKNOWN", 0, "")), (None, ("UNKNOWN", 0, "")), ('{"classification": "AI", "confidence": "hög"}', ("AI", 50, '{"classification": "AI", "confidence": "hög"}')),
    ],
)
def test_parse_response(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "t string").select(J.parse_response(F.col("t")).alias("p")).first()["p"]
    assert tuple(got) == want


def test_confusion_with_unknown(spark):
    rows = [(False, "AI"), (True, "AI"), (True, "MÄNNISKA"), (False, "UNKNOWN")]
    c = J.confusion(spark.createDataFrame(rows, "is_human boolean, predicted string").withColumn("k", F.lit(1)), ["k"]).first()
    assert (c["tp"], c["fp"], c["tn"], c["fn"]) == (1, 1, 1, 0) and c["accuracy"] == 0.5 and c["recall"] == 1


def test_supersede_resume_upsert(spark):
    items = spark.createDataFrame([(1, None), (2, None), (3, 1)], "item_id bigint, supersedes bigint")
    assert {r["item_id"] for r in P.supersede(items).collect()} == {2, 3}
    todo, done = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, "AI"), (2, "UNKNOWN")], "id int, predicted string")
    assert [r["id"] for r in P.resume(todo, done, ["id"], "predicted").collect()] == [2]
    assert {tuple(r) for r in P.upsert(spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string"), spark.createDataFrame([(2, "b")], "k int, v string"), ["k"]).collect()} == {(1, "a"), (2, "b")}
    with pytest.raises(ValueError):
        P.resolve_conditions(["other"])


def test_folds_keep_groups(spark):
    df = spark.range(200).select((F.col("id") % 40).alias("g"), (F.col("id") % 2).cast("int").alias("label"))
    assert S.folds(df, 5, 0, "g").groupBy("g").agg(F.count_distinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1
    sizes = [r["count"] for r in S.folds(df, 5, 0, "g", "label").groupBy("fold", "label").count().collect()]
    assert sizes == [20] * 10


def test_syntax_and_trees(spark):
    rows = [(1, 0, 0, "Jag", "jag", "PRON", "nsubj", 1, ""), (1, 0, 1, "ser", "se", "VERB", "ROOT", 1, ""), (1, 0, 2, "katten", "katt", "NOUN", "obj", 1, ""), (1, 0, 3, "som", "som", "PRON", "nsubj", 4, ""), (1, 0, 4, "sover", "sova", "VERB", "acl:relcl", 2, ""), (2, 0, 0, "Utan", "utan", "X", "dep", 0, "LOC")]
    a = spark.createDataFrame(rows, "doc_id bigint, sent int, i int, text string, lemma string, pos string, dep string, head_i int, ent string")
    got = {r["doc_id"]: r for r in N.syntactic(a).collect()}
    assert got[1]["tree_depth_max"] == 3 and got[1]["dep_distance_mean"] == pytest.approx(5 / 4) and got[1]["subordinate_clause_rate"] == 1
    assert got[2]["tree_depth_max"] == 0
    assert {r["doc_id"]: r["ner_total_rate"] for r in N.entity_rates(a).collect()}[2] == 100


def test_language_model_measures(spark):
    nll = spark.createDataFrame([(1, 0, 0, i, 1.0 + i) for i in range(4)] + [(1, 1, 1, i, 2.0) for i in range(2)] + [(2, 0, 0, 0, 1.0)], "doc_id bigint, sent int, window int, i int, nll double")
    got = {r["doc_id"]: r["perplexity"] for r in L.perplexity(nll).collect()}
    assert got[1] == pytest.approx(2.718281828**2.25, rel=1e-6) and got[2] is None
    w = spark.createDataFrame([([str(i) for i in range(10)],)], "t array<string>").select(L.windows(F.col("t"), 4, 2).alias("w")).first()["w"]
    assert [x["fresh"] for x in w] == [4, 2, 2, 2]


def test_windows_run_through_the_whole_document(spark):
    docs = spark.createDataFrame([(1, "Ett två tre. " * 600), (2, "Ett två. Tre fyra fem."), (3, None), (4, "ett " * 1025)], "doc_id bigint, text string")
    nll = L.unigram_nll(docs, "doc_id", "text")
    got = {(r["doc_id"], r["window"]): r["count"] for r in nll.groupBy("doc_id", "window").count().collect()}
    assert got == {(1, 0): 1024, (1, 1): 512, (1, 2): 264, (2, 0): 5, (4, 0): 1024, (4, 1): 1}
    fresh = docs.filter("doc_id = 1").select(F.explode(L.windows(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1)))).alias("w")).select("w.fresh").collect()
    assert [r["fresh"] for r in fresh] == [1024, 512, 264]
    assert {(r["sent"], r["i"]) for r in nll.filter("doc_id = 2").collect()} == {(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)}


def show(table) -> list[str]:
    """Rows as sorted texts: columns by name, numbers to six digits, one word for what is missing."""

    def one(v) -> str:
        if isinstance(v, (list, tuple, np.ndarray)):
            return str([one(x) for x in v])
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return "null"
        return f"{float(v) or 0.0:.6g}" if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)

    return sorted(str([one(v) for v in r]) for r in table[sorted(table.columns)].itertuples(index=False))


def test_queries_agree_with_their_sql(spark, sf):
    """Every core query with SQL, on the smallest tables."""
    import glob
    import os

    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for f in glob.glob(sf + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    named, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(named)
    for name in sorted(k for k in sql if not re.match(r"p\d+_", k)):
        got, want = named[name](spark, sf).toPandas(), con.execute(sql[name]).df()
        assert sorted(got.columns) == sorted(want.columns), name
        assert show(got) == show(want), name
    assert entry.entry(spark).count() > 0


def test_stream(spark, sf):
    import __spark_entry__ as entry

    assert entry.queries()["stream_totals"](spark, sf).count() > 0


def test_cumulate_over_ranges_signs_and_null_keys(spark):
    rows = [(k, float(v), 1 + abs(v) % 3) for k in ("a", None) for v in (-900, -3, -1, 0, 1, 2, 5, 70, 4000, 4001)] + [("a", 0.001, 5), ("a", -0.001, 2)]
    got = A.cumulate(spark.createDataFrame(rows, "k string, v double, n bigint"), ["k"], "v", ["n"]).collect()
    want = {(k, v): sum(m for q, u, m in rows if q == k and u < v) for k, v, _ in rows}
    assert {(r["k"], r["v"]): r["below_n"] for r in got} == want


def test_paired_tests_keep_null_keys(spark):
    df = spark.createDataFrame([(None, float(i), float(i * 2)) for i in range(8)], "k string, human double, llm double")
    r = A.paired_tests(df, ["k"]).first()
    assert r["k"] is None and r["n_pairs"] == 8 and r["median_human"] == 3.5 and r["median_llm"] == 7


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k string, human double, llm double, side string, value double, s double, y int")
    assert A.paired_tests(e, ["k"]).count() == 0 and A.wasserstein(e, ["k"]).count() == 0 and A.auc(e, ["k"], "s", "y").count() == 0


def test_seeded_rank_is_a_permutation_and_stable(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 3).alias("g"))
    a, b = (S.seeded_rank(d, ["g"], 1, "id").orderBy("id").collect() for d in (df, df.repartition(5)))
    assert a == b
    for g in (None, 1, 2):
        assert sorted(r["_before"] for r in a if r["g"] == g) == list(range(100))


def test_thread_assignment_takes_one_row_per_role(spark):
    df = spark.createDataFrame([(i, "big" if i < 500 else f"t{i % 7}" if i < 540 else "tiny") for i in range(542)], "row_id bigint, thread_id string")
    got = S.assign_threads(df, "thread_id", "row_id", {r: F.lit(True) for r in "abc"}, 2).groupBy("thread_id").agg(F.array_sort(F.collect_list("role")).alias("r"), F.count_distinct("row_id").alias("n")).collect()
    assert len(got) == 8 and all(r["r"] == ["a", "b", "c"] and r["n"] == 3 for r in got)


def test_forest(spark):
    """The forest is as good as pyspark.ml's, the same on every partitioning, and its histograms give the counts of a plain loop, shared between folds or not."""
    from pyspark.ml.functions import array_to_vector

    from korpusverk.operators import forest, ml

    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 5)).round(3)
    y = (x[:, 0] * x[:, 1] + x[:, 2] + rng.normal(size=400) > 0).astype(int)
    df = spark.createDataFrame([(i // 2, int(y[i]), x[i].tolist()) for i in range(400)], "id bigint, label int, x array<double>").withColumn("features", array_to_vector("x"))
    got = [{(r["id"], r["label"], r["fold"], round(r["score"], 9), r["predicted"]) for r in ml.cross_validate(d, "id", "rf", grouped=True, trees=30).collect()} for d in (df, df.repartition(7))]
    assert got[0] == got[1] and len({g[2] for g in got[0]}) == 5
    score = lambda rows: np.mean([(p[3] > n[3]) + 0.5 * (p[3] == n[3]) for p in rows if p[1] for n in rows if not n[1]])
    held = df.withColumn("weight", F.lit(1.0)).withColumn("far", F.col("id") % 5 == 0)
    fit = ml.estimator("rf", 0, 30).fit(held.filter("NOT far"))
    theirs = [(0, r["label"], 0, float(r["probability"][1])) for r in fit.transform(held.filter("far")).collect()]
    assert score(list(got[0])) > score(theirs) - 0.08

    bins, fold, row = forest.binned(x, [np.quantile(x[:, i], np.arange(1, 32) / 32) for i in range(5)]), np.arange(400) % 3, rng.integers(1 << 32, size=400, dtype=np.uint32)
    feature, cut_at = np.array([[[0], [0], [3]], [[1], [2], [4]]]), np.array([[[9], [9], [20]], [[9], [9], [9]]])
    out = np.zeros((2, 3, 3, 2, 2, forest.BINS), np.uint32)
    forest.histograms((bins, y.astype(np.int64), fold, row), 1, feature, cut_at, 3, 0, out)
    plain = np.zeros_like(out)
    for t in range(2):
        w, of = forest.draws(row, t, 0), forest.subsets(t, 1, 5, 0)
        for f in range(3):
            for i in np.flatnonzero(fold != f):
                node = int(bins[i, feature[t, f, 0]] > cut_at[t, f, 0])
                for j in range(3):
                    plain[t, f, j, node, y[i], bins[i, of[node, j]]] += w[i]
    assert (out == plain).all() and 0.9 < forest.draws(rng.integers(1 << 32, size=10_000, dtype=np.uint32), 1, 0).mean() < 1.1
