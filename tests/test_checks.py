"""Checks that fail, exact small-sample tests, quantiles of hot groups, assignments, restarts: against literals and brute force."""

import itertools
import warnings

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from korpusverk.functions import texts as T
from korpusverk.operators import annotations, features, language_model, pairing, sampling, scoring, stats
from korpusverk.sources import files
from korpusverk.streaming import events


def test_validated_join(spark):
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, w string")
    assert sorted(map(tuple, pairing.validated_join(left, right, "id").collect())) == [(1, "a", "x"), (2, "b", "y")]
    for l, r in ((left, right.union(right)), (left.union(spark.createDataFrame([(9, "c")], left.schema)), right), (left.union(spark.createDataFrame([(None, "c")], left.schema)), right)):
        with pytest.raises(ValueError):
            pairing.validated_join(l, r, "id")


def test_failing_checks(spark):
    items = spark.createDataFrame([(1, None), (2, 1), (3, 77)], "item_id bigint, supersedes bigint")
    assert {r["item_id"] for r in pairing.supersede(items).collect()} == {2, 3}
    with pytest.raises(ValueError, match="77"):
        pairing.supersede(items, strict=True)
    topics = spark.createDataFrame([("Vård",), ("Okänt",), (None,)], "topic string")
    assert pairing.known_values(topics, "topic", ["Vård", "Okänt"]).count() == 3
    with pytest.raises(ValueError, match="Okänt"):
        pairing.known_values(topics, "topic", ["Vård"])
    a, b = spark.createDataFrame([("t", " en  text ")], "l string, x string"), spark.createDataFrame([("t", "en text", 5), ("t", "en text", 4)], "l string, x string, id int")
    assert pairing.content_join(a, b, "l", "x", "id", complete=True).first()["match_id"] == 4
    with pytest.raises(ValueError):
        pairing.content_join(a.union(spark.createDataFrame([("u", "annan")], a.schema)), b, "l", "x", "id", complete=True)


def test_strict_pivot_fails_on_a_repeated_cell(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "i string, c string, v int")
    assert {tuple(r) for r in pairing.strict_pivot(df, "i", "c", "v", ["x", "y"]).collect()} == {("a", 1, 2), ("b", 3, None)}
    with pytest.raises(PySparkException):
        pairing.strict_pivot(df.union(df), "i", "c", "v", ["x", "y"]).collect()


def test_signed_ranks_are_exact_for_few_pairs(spark):
    """All sign patterns of up to nine ranks by brute force."""
    rows = [(n, s) for n in range(1, 10) for s in range(n * (n + 1) // 4 + 1)]
    got = spark.createDataFrame(rows, "n int, s int").withColumn("p", stats.signed_rank_p(F.col("s"), F.col("n"))).collect()
    for r in got:
        sums = [sum(k + 1 for k, up in enumerate(signs) if up) for signs in itertools.product((0, 1), repeat=r["n"])]
        assert r["p"] == pytest.approx(min(1, 2 * np.mean(np.array(sums) <= r["s"])))


def test_quantiles_of_a_hot_group(spark):
    """A group with a third of all rows, nulls, negative numbers, ties, one with a single value."""
    rng = np.random.default_rng(2)
    values = [("a", float(v)) for v in rng.normal(0, 100, 900).round(1)] + [("b", float(v)) for v in rng.integers(-3, 4, 600)] + [("c", 2.5), ("d", None)]
    got = {r["k"]: r for r in stats.quantiles(spark.createDataFrame(values, "k string, v double"), ["k"], "v", {"low": 0.0, "q": 0.37, "m": 0.5, "top": 1.0}).collect()}
    assert set(got) == {"a", "b", "c"}
    for k in "abc":
        own = [v for x, v in values if x == k]
        assert [got[k][n] for n in ("low", "q", "m", "top")] == pytest.approx(np.quantile(own, [0, 0.37, 0.5, 1]).tolist())


def test_threads_serve_the_scarcest_role_first(spark):
    rows = [("t1", 1, True, True), ("t1", 2, True, False), ("t2", 3, True, True), ("t2", 4, False, False), ("t3", 5, True, False), ("t3", 6, False, True), (None, 7, None, None)] + [("hot", i, True, i % 700 == 0) for i in range(100, 2100)]
    df = spark.createDataFrame(rows, "t string, k bigint, a boolean, b boolean")
    got = {(r["t"], r["role"]): r["k"] for r in sampling.assign_threads(df, "t", "k", {"a": F.col("a"), "b": F.col("b")}, 3).collect()}
    assert got["t1", "b"] == 1 and got["t1", "a"] == 2 and got["t3", "a"] == 5 and got["t3", "b"] == 6 and not any(t == "t2" for t, _ in got)
    assert got["hot", "b"] % 700 == 0 and got["hot", "a"] != got["hot", "b"]


def test_contrasts_keep_generators_and_conditions_apart(spark):
    rows = [("j", g, "formal", c, f"p{i}", False, "AI", ok) for i in range(4) for g, c, ok in (("x", "base", i < 3), ("x", "free", i < 1), ("y", "base", i < 2))]
    judged = spark.createDataFrame(rows, "judge string, generator string, register string, condition string, pair_id string, is_human boolean, predicted string, correct boolean")
    by_condition = scoring.contrasts(judged, ["judge", "generator", "register"], "condition").collect()
    assert [(r["generator"], r["name_a"], r["name_b"], r["n_pairs"], r["b"], r["c"], r["p_value"]) for r in by_condition] == [("x", "base", "free", 4, 2, 0, pytest.approx(0.5))]
    by_generator = scoring.contrasts(judged, ["judge", "register", "condition"], "generator").collect()
    assert [(r["condition"], r["name_a"], r["name_b"], r["n_pairs"], r["b"], r["c"]) for r in by_generator] == [("base", "x", "y", 4, 1, 0)]


def test_twins(spark):
    assert features.twins(["human_b", "human_a", "llm_a", "llm_b", "llm_c", "human_d"]) == ["b", "a"]
    assert features.twin_pairs(spark.createDataFrame([(1, 2.0)], "k int, human_a double"), ["k"]).count() == 0


def test_lost_lines_are_warned_about(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text\n" + "".join(f"{i},ord\n" for i in range(8)) + "x,ord\nbara text\n", encoding="utf-8")
    with pytest.warns(UserWarning, match="20.0%"):
        assert files.repaired_csv(spark, str(tmp_path / "a.csv"), "id bigint, text string").count() == 8
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        files.repaired_csv(spark, str(tmp_path / "a.csv"), "id bigint, text string", warn_above=0.5)


def test_tables_are_replaced_again_and_again(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (1, 2, 3):
        assert files.replace_table(spark.range(n), path) == n
    assert spark.read.parquet(path).count() == 3 and spark.read.parquet(path + ".bak").count() == 2


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    """New files after a restart under the same name and run: nothing twice, nothing lost, in both modes."""
    source = tmp_path / "in"
    rows = lambda a, b: spark.createDataFrame([(i % 3, 1.0) for i in range(a, b)], "user_id bigint, value double").coalesce(1)
    rows(0, 30).write.mode("append").parquet(str(source))
    stream = lambda: spark.readStream.schema("user_id bigint, value double").parquet(str(source))
    run = tmp_path.name + str(abs(hash(str(tmp_path))))
    assert events.drain(stream(), "rows", run=run).count() == 30 and events.drain(events.running_totals(stream()), "sums", "update", run=run).count() == 3
    rows(30, 60).write.mode("append").parquet(str(source))
    assert events.drain(stream(), "rows", run=run).count() == 60
    last = events.drain(events.running_totals(stream()), "sums", "update", run=run).groupBy("user_id").agg(F.max("n").alias("n"), F.max("total").alias("t"))
    assert {tuple(r) for r in last.collect()} == {(u, 20, 20.0) for u in range(3)}


def test_unigram_likelihoods_with_a_hot_word(spark):
    docs = spark.createDataFrame([(i, "hot hot hot ord" + chr(97 + i % 26)) for i in range(900)] + [(9000, None), (9001, "")], "doc_id bigint, text string")
    nll = language_model.unigram_nll(docs, "doc_id", "text")
    hot = nll.filter("nll < 1").agg(F.count(F.lit(1)), F.count_distinct("nll")).first()
    assert tuple(hot) == (2700, 1) and nll.count() == 3600


#: A parsed sentence, by hand: Katten som sov i Lund vaknade . Den åt .
PARSED = [
    (1, 0, 0, "Katten", "katt", "NOUN", "nsubj", 5, None), (1, 0, 1, "som", "som", "PRON", "nsubj", 2, None), (1, 0, 2, "sov", "sova", "VERB", "acl:relcl", 0, None), (1, 0, 3, "i", "i", "ADP", "case", 4, None), (1, 0, 4, "Lund", "Lund", "PROPN", "obl", 2, "LOC"),
    (1, 0, 5, "vaknade", "vakna", "VERB", "ROOT", 5, None), (1, 0, 6, ",", ",", "PUNCT", "punct", 5, None), (1, 1, 0, "Den", "den", "PRON", "nsubj", 1, "PRS"), (1, 1, 1, "åt", "äta", "VERB", "ROOT", 1, None),
]


@pytest.fixture(scope="module")
def parsed(spark):
    return spark.createDataFrame(PARSED, "doc_id bigint, sent int, i int, text string, lemma string, pos string, dep string, head_i int, ent string")


def test_syntax_of_a_real_tree(parsed):
    r = annotations.syntactic(parsed).first()
    # distances 5, 1, 2, 1, 2, 1, 1; the longest path is vaknade, Katten, sov, Lund, i
    assert r["dep_distance_mean"] == pytest.approx(13 / 7) and (r["tree_depth_mean"], r["tree_depth_max"], r["subordinate_clause_rate"], r["n_sentences"]) == (2.5, 4, 0.5, 2)


def test_entities_tags_and_relations_of_a_real_tree(parsed):
    e = annotations.entity_rates(parsed).first()
    assert e["ner_LOC_rate"] == e["ner_PRS_rate"] == pytest.approx(12.5) and e["ner_total_rate"] == pytest.approx(25.0) and e["ner_ORG_rate"] == 0
    p = annotations.pos_shares(parsed).first()
    assert p["pos_VERB"] == pytest.approx(3 / 9) and p["pos_PRON"] == pytest.approx(2 / 9) and p["content_tokens"] == 8 and p["n_unique_lemmas"] == 9
    assert annotations.top_relations(parsed, 2).first()["top_relations"] == '{"nsubj":3,"ROOT":2}'
    assert annotations.inspection(parsed).filter("sent = 0").first()["entities"] == "Lund:LOC"


def test_cells_of_labels_with_colons(spark):
    df = spark.createDataFrame([("acl:relcl: 3 | obl: 1 | trasig", "obl: 1 | nsubj: 1")], "a string, b string")
    a, b = T.decode_map(F.col("a")), T.decode_map(F.col("b"))
    got = df.select(a.alias("m"), T.map_difference(a, b).alias("d")).first()
    assert got["m"] == {"acl:relcl": 3, "obl": 1} and got["d"] == {"acl:relcl": 0.75, "obl": -0.25, "nsubj": -0.5}


PAGE = """<!DOCTYPE html><html><head><title>Forum</title></head><body><h1 class="x"> Bästa <b>osten</b>? </h1><span>2016-03-04, 12:11</span>
<div id="post_1" class="post_message"><blockquote>Du skrev:<br/>något</blockquote>Västerbotten,<br>utan tvekan.<p>Eller Präst &amp; dill.</p></div>
<div class="post_message">Andra svaret</div></body></html>"""


def test_html_page(spark):
    r = spark.createDataFrame([(PAGE,), ("",), (None,)], "h string").select(*[c.alias(k) for k, c in files.html_threads(F.col("h")).items()]).collect()
    assert r[0]["date"] == "2016-03-04" and r[0]["post"] == "Västerbotten,\nutan tvekan.\nEller Präst &amp; dill." and r[1]["post"] == "" and r[2]["post"] is None


#: Answers as judges give them, with what is to be read from them.
ANSWERS = [
    ('{"classification": "AI", "confidence": 85, "reasoning": "Mallartad text."}', ("AI", 85, "Mallartad text.")), ('Här är mitt svar:\n```json\n{"classification": "Människa", "confidence": "62.7", "reasoning": ""}\n```', ("MÄNNISKA", 62, "")),
    ('{"classification": "AI"}', ("AI", 50, "")), ("Texten är skriven av en människa.", ("MÄNNISKA", 50, "Texten är skriven av en människa.")), ("Vet ej", ("UNKNOWN", 0, "Vet ej")), ("", ("UNKNOWN", 0, "")), (None, ("UNKNOWN", 0, "")),
    ('{"classification": "varken eller", "confidence": 10}', ("UNKNOWN", 10, "")), ('{"classification": "AI", "confidence": 40', ("AI", 50, '{"classification": "AI", "confidence": 40')),
]


def test_answers_of_judges(spark):
    got = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(ANSWERS)], "i int, a string").select("i", scoring.parse_response(F.col("a")).alias("p")).orderBy("i").collect()
    assert [tuple(r["p"]) for r in got] == [w for _, w in ANSWERS]


def test_tokens_are_not_broadcast(spark):
    """Texts that the planner takes for small give more tokens than may be broadcast; sentences made in place equal those of the annotation table, also for null and repeated ids."""
    text = "Vi bor i Umeå, som är en stad. Att bo här är bra!  Ja? 12 hundar\nkom. " * 3
    rows = [(1, text), (2, text + "Slut"), (None, "En katt sov i Lund."), (3, ""), (4, None), (5, "...")]
    once = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = lambda df: sorted(map(tuple, df.collect()), key=str)
    general = annotations.inspection(annotations.from_tokens(once))
    assert "Broadcast" not in general._jdf.queryExecution().executedPlan().toString()
    found = annotations.inspection_by_rule(once)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert whole(found) == whole(general) and (None, 0, "En/ROOT/En | katt/dep/En | sov/dep/katt | i/dep/sov | Lund/dep/i | ./dep/Lund", "Lund:LOC") in whole(found)
    twice = once.union(spark.createDataFrame([(2, "Hej då."), (None, "Nu."), (6, "Ny.")], once.schema))
    assert whole(annotations.inspection_by_rule(twice)) == whole(annotations.inspection(annotations.from_tokens(twice)))
