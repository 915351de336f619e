"""Text functions on small literal rows."""

import pytest
from pyspark.sql import functions as F

from korpusverk.functions import texts as T
from korpusverk.operators import features as X
from korpusverk.sources import files


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("### Rubrik\ntext", "Rubrik\ntext"), ("**fet** och *kursiv* och `kod`", "fet och kursiv och kod"), ("Sammanfattning: Här börjar det", "Här börjar det"), ("Text.\n\nNyckelord: a, b", "Text."), ("a\n\n\n\nb", "a\n\nb"), (None, None), ("", "")],
)
def test_normalize_formal(spark, text, want):
    assert one(spark, text, T.normalize_formal) == want
    assert one(spark, text, lambda c: T.normalize_formal(c, True)) == text


@pytest.mark.parametrize(
    ("text", "want", "kind"),
    [("a &amp;gt; b", "a &gt; b", "html_entity"), (">citat\nsvar", "citat\nsvar", "quote_marker"), (">10% av alla", ">10% av alla", "whitespace_only"), ("a >b", "a b", "quote_marker"), ("Hej. Mvh Kalle", "Hej.", "signoff"), ("a\n\n\nb", "a\n\nb", "blank_lines")],
)
def test_normalize_informal(spark, text, want, kind):
    assert one(spark, text, T.normalize_informal) == want
    assert one(spark, text, T.artefacts) == kind


def test_quoted_lines_can_go(spark):
    assert one(spark, ">citat här\nsvar", lambda c: T.normalize_informal(c, True)) == "svar"


def test_refusals(spark):
    assert one(spark, "Jag kan tyvärr inte hjälpa till med det.", T.refusal_reason) == "sv: 'jag kan inte <task verb>'"
    assert one(spark, "I cannot really write this", T.refusal_reason) == "en: 'I can't <task verb>'"
    assert one(spark, "Jag kan inte hitta det på TV.nu", T.refusal_reason) is None
    assert one(spark, "x" * 300 + " I can't help", T.refusal_reason) is None


@pytest.mark.parametrize(("text", "want"), [("2009-03-04 kl 12", "2009-03-04"), ("den 4 mars 2009", "2009-03-04"), ("31 feb 2009", None), ("2009-13-01", None), ("Igår", None), (None, None), ("7 OKTOBER 2011", "2011-10-07")])
def test_parse_date(spark, text, want):
    got = one(spark, text, T.parse_date)
    assert (str(got) if got else None) == want


def test_map_codec(spark):
    back = one(spark, "acl:relcl:3 | LOC:1 | PRS: 5", T.decode_map)
    assert back == {"acl:relcl": 3, "LOC": 1, "PRS": 5}
    assert one(spark, "acl:relcl:3 | LOC:1", lambda c: T.decode_map(c, last=False)) == {"LOC": 1}
    assert one(spark, "LOC:1 | PRS:5", lambda c: T.encode_map(T.decode_map(c))) == "LOC:1 | PRS:5"
    assert one(spark, None, T.decode_map) == {}
    assert one(spark, "a, ,b,,", T.token_cell_length) == 2


def test_counts(spark):
    assert one(spark, "Ett, två... tre…", lambda c: T.literal_count(c, "...")) == 1
    assert one(spark, "Ett, två.", T.token_count) == 4
    assert one(spark, None, T.token_count) == 0
    assert one(spark, "Båda åarna", T.syllables) == 4
    assert one(spark, "Hej. Vad nu? Ja!", lambda c: F.size(T.sentences(c))) == 3
    for text, ok in ((None, False), ("", False), ("  \n\xa0", False), (" NaN ", False), ("nana", True)):
        assert one(spark, text, T.non_empty) is ok


def test_diversity_limits(spark):
    words = lambda n, k: " ".join("abcdefghijklmnopqrstuvwxyz"[i % k] * (1 + i % k // 26) for i in range(n))
    tok = T.alpha_tokens
    assert one(spark, words(99, 5), lambda c: X.mattr(tok(c))) == one(spark, words(99, 5), lambda c: X.ttr(tok(c)))
    assert one(spark, words(101, 5), lambda c: X.mattr(tok(c))) == pytest.approx(0.05)
    assert one(spark, "", lambda c: X.mattr(tok(c))) == 0
    assert one(spark, words(9, 9), lambda c: X.mtld(tok(c))) is None
    assert one(spark, words(10, 10), lambda c: X.mtld(tok(c))) == 10.0
    assert one(spark, "a b a b a", lambda c: X.ngram_repetition(T.surface_tokens(c), 2)) == pytest.approx(0.5)
    assert one(spark, "a", lambda c: X.ngram_repetition(T.surface_tokens(c), 2)) == 0


def test_phrases_do_not_overlap(spark):
    assert one(spark, "Det skulle kunna gå, han kan kan", lambda c: X.lexicon_count(T.alpha_tokens(c), "hedge")) == 3
    assert one(spark, "i stort sett i viss mån", lambda c: X.lexicon_count(T.alpha_tokens(c), "hedge")) == 2


def test_gated_hedges(spark):
    df = spark.createDataFrame([(["rätt", "bra", "rätt"], ["ADV", "ADJ", "NOUN"])], "w array<string>, p array<string>")
    assert df.select(X.gated_hedges("w", "p").alias("n")).first()["n"] == 1


def test_csv_repair(spark):
    """Quoted line breaks, stray quotes, empty fields, a quote before a comma inside the last field, broken lines, one column, no lines, a very long field."""
    raw = 'id,text,note\n1,"a ""b"" c",x\n2,"rad\nbryt, och "citat" här","slut, "x", nu"\r\n3,,\n4,"",""\nbara en trasig rad\n6,"öppen, aldrig stängd\n7,x,y\n'
    wide = 'a,b\n1,"' + 'x "y" ,z\n' * 100_000 + '"\n'
    rows = [("a", raw), ("b", 'id\n1\n"två\nrader"\n'), ("c", ""), ("d", None), ("e", wide)]
    got = files.repaired_lines(spark.createDataFrame(rows, "path string, value string")).orderBy("path", "n").collect()
    lines = {p: [r["line"] for r in got if r["path"] == p] for p in "abcde"}
    assert lines["a"] == ["id,text,note", '1,"a ""b"" c",x', '2,"rad bryt, och ""citat"" här","slut, ""x"", nu"', "3,,", '4,"",""', "bara en trasig rad", '6,"öppen, aldrig stängd', "7,x,y"]
    assert lines["b"] == ["id", "1", '"två rader"'] and lines["c"] == lines["d"] == [] and len(lines["e"]) == 2 and len(lines["e"][1]) == 4 + 11 * 100_000


def test_csv_files(spark, tmp_path):
    (tmp_path / "detection_results_a.csv").write_text('id,text\n1,"rad ett\nrad två"\n2,"han sa "hej", och gick"\n', encoding="utf-8")
    got = files.repaired_csv(spark, str(tmp_path), "id bigint, text string").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "rad ett rad två"), (2, 'han sa "hej", och gick')]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("formal", "baseline", 1), ("informal", "baseline", 2)], "dataset string, condition string, v int")
    files.write_partitioned(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).filter("dataset = 'formal'").count() == 1
    files.append_new(df, str(tmp_path / "a"), ["v"])
    files.append_new(df, str(tmp_path / "a"), ["v"])
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2
    assert files.replace_table(df.limit(1), str(tmp_path / "a"), dry_run=True) == 1
    assert files.replace_table(df.limit(1), str(tmp_path / "a")) == 1 and spark.read.parquet(str(tmp_path / "a.bak")).count() == 2
    assert files.optional(spark, str(tmp_path / "none"), "x int").count() == 0
    assert files.first_existing(spark, [str(tmp_path / "none"), str(tmp_path / "p")]).endswith("/p")
    assert "| formal |" in files.markdown_table(df)
    assert files.annotate(df, lambda rows: [{"v": r["v"] * 2} for r in rows], "v int").agg(F.sum("v")).first()[0] == 6


def test_sources_by_name_and_schema(spark, tmp_path):
    for name, text in (("detection_results_gpt.csv", 'id,text\n1,"a\nb"\n'), ("detection_results_claude.csv", 'id,text\n2,"sa ""hej"""\n'), ("other.txt", "x")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    scan = files.csv_scan(spark, str(tmp_path / "detection_results_*.csv"), "id int, text string").withColumn("judge", files.entity_of_file(r"detection_results_(.+)\.csv"))
    assert sorted(map(tuple, scan.collect())) == [(1, "a\nb", "gpt"), (2, 'sa "hej"', "claude")]
    with pytest.raises(FileNotFoundError):
        files.first_existing(spark, [str(tmp_path / "none")])


def test_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "k int, v array<double>")
    files.write_vectors(df, str(tmp_path / "v"), "k", "v")
    assert dict(spark.read.parquet(str(tmp_path / "v")).dtypes)["v"] == "array<float>"
    with pytest.raises(ValueError):
        files.write_vectors(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], df.schema), str(tmp_path / "v"), "k", "v")


def test_templates(spark):
    df = spark.createDataFrame([("{a} och {b}", "x", None)], "t string, a string, b string")
    assert df.select(T.fill(F.col("t"), a=F.col("a"), b=F.col("b")).alias("r")).first()["r"] == "x och "
