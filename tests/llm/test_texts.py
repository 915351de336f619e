"""Text operators: edge cases, round trips and held-out examples."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from korpusverk.llm import languages, letters, mixing, pairs, personal, quality, reading, stuffing, tokens

PROSE = "Det här är en helt vanlig text om hundar. Jag brukar gå ut med hunden varje dag, men ibland regnar det. Då stannar vi hemma och läser."
LONG = "ordet " * 200_000
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, PROSE), (4, PROSE), (5, LONG), (6, "👩‍👩‍👧 ​ ½ 日本語")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, repeated and very long texts, and columns whose names differ from ours only in case."""
    rows = [(i, t, 0, "x") for i, t in ODD]
    return spark.createDataFrame(rows, "id bigint, t string, ID bigint, kind string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "id bigint, t string")


@pytest.fixture(scope="module")
def known(spark):
    rows = [("sv", PROSE), ("sv", "Jag vet inte vad som är bäst, men det kostar inte så mycket att prova en gång till."), ("sv", "Hur gör ni för att få ihop det när alla vill något annat?")]
    rows += [("en", "I do not know what is best, but it does not cost much to try it once more."), ("en", "How do you make it work when everybody wants something else? The results show that this is hard.")]
    rows += [("fi", "En tiedä mikä on parasta, mutta se ei maksa paljon. Tutkimuksen tavoitteena on selvittää asia."), ("de", "Ich weiß nicht, was am besten ist, aber es kostet nicht viel. Die Ergebnisse zeigen das."), ("no", "Jeg vet ikke hva som er best, men det koster ikke mye."), ("da", "Jeg ved ikke, hvad der er bedst, men det koster ikke meget."), (None, "x"), ("sv", None)]
    return languages.fit(spark.createDataFrame(rows * 3, "lang string, text string"), "text", "lang")


# --- tokens -------------------------------------------------------------------------------------------------------------------


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


HARD = ["", None, " ", "a  b", "a  \n b", "don't 'stop'", "!'s", "x's'll", "a1b2", "åäö Å", "a  b", " x   y", "👍🏽  👍🏽", "<|endoftext|> x", "0123456789 " * 3, "日本語の短い文。", "é é", "a" * 5000, "tab\t\tnbsp\xa0 rad\r\nslut ", "  inledning", "(a)(b)[c]{d}", "…'s", "\x00\x01"]


def test_tokens_equal_the_public_library():
    with open(tokens.default_path(), "rb") as f:
        ready = tokens.prepare(f.read())
    offsets, ids = tokens.encode(pa.array(HARD), ready)
    got = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
    assert got == reference_ids(HARD)


def test_tokens_random_bytes_of_text():
    rng = np.random.default_rng(5)
    alphabet = list("aåbc '’\n\t.,!?19()<|>-é日👍  'sSt")
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(1500)]
    with open(tokens.default_path(), "rb") as f:
        ready = tokens.prepare(f.read())
    offsets, ids = tokens.encode(pa.array(texts), ready)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == reference_ids(texts)


def test_tokens_of_odd_rows(odd, empty):
    got = tokens.encode_corpus(odd, "id", "t").collect()
    assert len(got) == len(ODD) and all(r["ids"] is not None for r in got)
    assert sorted(len(r["ids"]) for r in got if r["id"] in (1, 2)) == [0, 0]
    assert tokens.encode_corpus(empty, "id", "t").count() == 0


# --- mixing -------------------------------------------------------------------------------------------------------------------


def test_schedule_is_even(spark):
    plan = mixing.schedule(spark, [("a", 0.5), ("b", 0.3), ("c", 0.2)], 1000).toPandas()
    for name, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        seen = (plan.sort_values("position").source == name).cumsum().to_numpy()
        assert np.abs(seen - share * np.arange(1, 1001)).max() < 6


def test_mix_shares_caps_and_edges(spark):
    docs = [(i, "ett två tre fyra fem sex", "big") for i in range(3000)] + [(i, "ett två tre fyra fem sex", "small") for i in range(3000, 3050)] + [(9001, None, "big"), (9002, "", "small"), (9003, "text", None), (9004, "text", "untargeted")]
    targets = [("big", 0.6, 1), ("small", 0.2, 4), ("none", 0.2, 3)]
    chosen, shares = mixing.mix(spark.createDataFrame(docs, "doc_id bigint, text string, source string"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int"))
    c, s = chosen.toPandas(), shares.toPandas().set_index("source")
    assert c.groupby("source").repeats.max().to_dict() == {"big": 1, "small": 4} and not set(c.doc_id) & {9001, 9002, 9003, 9004}
    assert s.loc["none", "tokens"] == 0 and s.loc["small", "documents"] == 50
    assert s.actual_share.sum() == pytest.approx(1) and s.loc["big", "actual_share"] == pytest.approx(0.75, abs=0.01)
    places = sorted(x for p in c.positions for x in p)
    assert len(set(places)) == c.repeats.sum() and (c.positions.map(len) == c.repeats).all()
    again = mixing.mix(spark.createDataFrame(docs, "doc_id bigint, text string, source string").repartition(9), spark.createDataFrame(targets, "source string, target_share double, max_repeats int"))[0].toPandas()
    assert set(map(tuple, again[["doc_id", "repeats"]].values)) == set(map(tuple, c[["doc_id", "repeats"]].values))


def test_mix_reaches_the_targets_when_it_can(spark):
    docs = [(i, f"ord {i} och {i * 7}", "abcd"[i % 4]) for i in range(4000)]
    targets = [("a", 0.1, 1), ("b", 0.2, 1), ("c", 0.3, 2), ("d", 0.4, 2)]
    _, shares = mixing.mix(spark.createDataFrame(docs, "doc_id bigint, text string, source string"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int"))
    assert all(abs(r["actual_share"] - r["target_share"]) < 0.01 for r in shares.collect())


def test_mix_with_a_larger_budget_reports_what_is_missing(spark):
    docs = spark.createDataFrame([(i, f"ord {i} och {i * 7} till", "ab"[i % 10 == 0]) for i in range(4000)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2), ("c", 0.0, 5), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    held = {r["source"]: r["tokens"] for r in mixing.mix(docs, targets)[1].collect()}
    assert abs(held["a"] / held["b"] - 1) < 0.02
    chosen, shares = mixing.mix(docs, targets, budget=4 * held["a"])
    more = {r["source"]: r for r in shares.collect()}
    assert more["b"]["actual_share"] < 0.4 and more["b"]["most_repeats"] == 2 and more["c"]["tokens"] == 0 and chosen.filter("repeats > 2").count() == 0


def test_mix_with_clashing_names_and_nulls(spark):
    docs = spark.createDataFrame([(1, "ett två", "a", "x"), (2, None, "a", "x"), (None, "tre", "a", "x"), (3, "fyra", None, "x")], "doc_id bigint, text string, source string, SOURCE string")
    targets = spark.createDataFrame([("a", 1.0, 1, 9), (None, None, None, 9), ("b", None, None, 9)], "source string, target_share double, max_repeats int, Source int")
    chosen, shares = mixing.mix(docs, targets)
    assert {r["doc_id"] for r in chosen.collect()} <= {1, None} and chosen.count() >= 1
    assert {r["source"]: r["actual_share"] for r in shares.collect()} == {"a": 1.0, "b": 0.0}


def test_mix_of_nothing(spark):
    chosen, shares = mixing.mix(spark.createDataFrame([], "doc_id bigint, text string, source string"), spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int"))
    assert chosen.count() == 0 and shares.first()["actual_share"] == 0


# --- quality ------------------------------------------------------------------------------------------------------------------

KINDS = [
    ("list", "- mjölk\n- bröd\n- ost\n- smör"), ("list", "Att göra\nDiska golvet\nRinga mamma\nTräningen\nHandla"), ("list", "1) ett par skor\n2) en jacka\n3) två hattar\n4) en väska"),
    ("table", "namn;pris;antal\näpple;12;3\npäron;7;?\nplommon;9;44"), ("table", "| a | 1 | 2 |\n| b | 3 | 4 |"), ("table", "vara     120     3\nannan    77      -\ntredje   5       12"),
    ("junk", "######## ===== ~~~~~ %%%%"), ("junk", "aaaaaaaaaaaaaaaaaaaa!!!!!!!!!!!!"), ("junk", "kdjfhg wqxzrt bvncmx plkjhg"), ("junk", "<td>&nbsp;</td><br/><td></td>{\"id\":3}\\n"), ("junk", "s904E0wDcY5QAarp6cchm3Fo0xqIu81YYfNn7KpsncTeKkQ6"),
    ("prose", PROSE), ("prose", PROSE.replace(". ", ".\n")), ("prose", PROSE + "\n- mjölk\n- bröd\n" + PROSE), ("prose", PROSE.lower().replace(".", "")), ("short", "Tack!"), ("short", "+1"), ("blank", " \n"), ("blank", None),
]


def test_kinds(spark):
    rows = [(i, t, k) for i, (k, t) in enumerate(KINDS)] + [(100 + i, PROSE, "prose") for i in range(40)]
    got = quality.text_statistics(spark.createDataFrame(rows, "id bigint, t string, want string"), "id", "t", "want").collect()
    assert [(KINDS[r["id"]][1], r["want"], r["kind"]) for r in got if r["want"] != r["kind"]] == []


def test_repetition_is_boilerplate(spark):
    sentence = "Vår butik i hamnen har öppet alla dagar hela sommaren för dig som vill handla fisk. "
    rows = ["köp billiga skor nu " * 200, (PROSE.replace(". ", ".\n") + "\n") * 20, (PROSE + "\n\n") * 3, sentence * 30]
    assert quality.kind(dict(zip(quality.STATS, (*quality.describe("Att göra\nStekpannan\nStekpannan\nKryddningen\nEtt lugnare pass\nKryddningen\nEtt lugnare pass\nStekpannan"), -1.5)))) == "list"
    fine = [PROSE + " " + PROSE, PROSE + "\n" + PROSE.replace("hundar", "katter"), " ".join(f"Mening nummer {'abcdefghij'[i % 10] * 3}{'klmnopqrst'[i // 10] * 2} handlar om något." for i in range(60))]
    got = quality.text_statistics(spark.createDataFrame([*enumerate(rows + fine)], "id bigint, t string"), "id", "t").collect()
    assert [r["kind"] for r in sorted(got, key=lambda r: r["id"])] == ["boilerplate"] * len(rows) + ["prose"] * len(fine)


def test_repetition_decides(spark):
    """Without the repetition statistics more than a third of the lists, tables and junk would be lost; none of the prose is won by them."""
    off = ("repeated_shape_share", "table_line_share", "duplicate_line_share", "duplicate_paragraph_share", "top_bigram_share", "top_trigram_share", "top_fourgram_share", "longest_run_share")
    found = [(k, dict(zip(quality.STATS, (*quality.describe(t), -2.0)))) for k, t in KINDS]
    cases = [(k, s) for k, s in found if k in ("list", "table", "junk")]
    lost = [k for k, s in cases if quality.kind(s) == k and quality.kind(s | dict.fromkeys(off, 0.0)) != k]
    assert len(lost) > len(cases) / 3 and {"list", "table", "junk"} == set(lost)


def test_statistics_by_hand(spark):
    t = "ett två ett två ett två\nett två ett två ett två\n\nslut."
    r = quality.text_statistics(spark.createDataFrame([(1, t)], "id bigint, t string"), "id", "t").first()
    assert r["char_count"] == len(t) and r["word_count"] == 13 and r["line_count"] == 3 and r["duplicate_line_share"] == pytest.approx(1 / 3)
    assert r["ended_line_share"] == pytest.approx(1 / 3) and r["top_bigram_share"] == pytest.approx(6 * 7 / len(t))


def test_quality_of_odd_rows(odd, empty):
    got = quality.text_statistics(odd, "id", "t").collect()
    assert len(got) == len(ODD) and {r["kind"] for r in got if r["id"] in (1, 2, 3)} == {"blank"}
    assert quality.not_prose(empty, "id", "t").count() == 0


# --- keyword pages ------------------------------------------------------------------------------------------------------------


def test_spam_pages(spark):
    rng = np.random.default_rng(1)
    goods = "matta gardiner elcykel hörlurar klocka takbox skidor solpanel hundbädd kattmat".split()
    rows = [(i, PROSE.replace("hundar", g) + f" Nummer {i} kom i går.") for i, g in enumerate(goods * 12)]
    salad = " ".join("#" + rng.choice(goods) for _ in range(60))
    stuffed = ", ".join(rng.choice(["billig matta", "matta", "köp matta", "matta rea"]) for _ in range(60))
    sentences = "Hos oss hittar du billig matta och mer billig matta. Därför är billig matta rätt billig matta när du behöver billig matta. " * 3
    linked = "\n".join(f"http://butik{i}.example/rea?id={i}" for i in range(12))
    rows += [(1001, salad), (1002, stuffed), (1003, sentences), (1004, linked), (1005, PROSE + "\n\nNyckelord: hundar, regn, promenader"), (1006, PROSE + " Se http://a.example/x och www.b.example."), (1007, None), (1008, "")]
    got = {r["id"] for r in stuffing.spam_pages(spark.createDataFrame(rows, "id bigint, t string"), "id", "t").collect()}
    assert got == {1001, 1002, 1003, 1004}


def test_measures_by_hand(spark):
    """Counts of the corpus against plain counters; a page's own pairs are left out."""
    from collections import Counter

    texts = ["en hund och en katt", "en hund sover", "12 hundar och 7 katter http://a.example/x", "", None, "en hund och en katt"]
    counts = stuffing.count_corpus(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    words = [["en", "hund", "och", "en", "katt"], ["en", "hund", "sover"], ["0", "hundar", "och", "0", "katter", "<"], ["en", "hund", "och", "en", "katt"]]
    assert stuffing.Batch([t or "" for t in texts]).sizes.tolist() == [5, 3, 6, 0, 0, 5]
    single, double = Counter(w for ws in words for w in ws), Counter(p for ws in words for p in zip(ws, ws[1:]))
    assert counts[0] == sum(single.values()) and counts[1] == sum(double.values()) and sorted(counts[5]) == sorted(n for n in double.values() if n > 1)
    pmi, excess = stuffing.measures(stuffing.Batch(["en hund flyger"]), counts)
    assert pmi[0] == pytest.approx(np.log((double["en", "hund"] - 1) * counts[0] / single["en"] / single["hund"]) / 2) and excess[0] == 0
    pmi, excess = stuffing.measures(stuffing.Batch(["", "rea", "rea " * 5]), counts)
    assert pmi.tolist() == [0, 0, 0] and excess.tolist() == pytest.approx([0, 0, np.log(counts[1] / 4)])


def test_rare_pairs_count(spark, monkeypatch):
    """Where few words and pairs are common enough to be broadcast, all others still have their exact counts: the same numbers as with every count broadcast, by hand too."""
    from collections import Counter

    rng = np.random.default_rng(3)
    texts = [" ".join(f"ord{int(w)}" for w in rng.zipf(1.4, 30) % 400) for _ in range(60)] + ["en hund", "en hund", "hund", "", None, "ensam", "billig matta " * 9]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "id bigint, t string")
    get = lambda: sorted(map(tuple, stuffing.page_features(df, "id", "t").select("id", "words", "mean_pmi", "fragment_share").collect()))
    whole = get()
    monkeypatch.setattr(stuffing, "SHARE", 16)
    assert len(stuffing.count_corpus(df, "t")[5]) <= 16
    for a, b in zip(get(), whole, strict=True):
        assert a == pytest.approx(b)
    words = [(t or "").split() for t in texts]
    single, double = Counter(w for ws in words for w in ws), Counter(p for ws in words for p in zip(ws, ws[1:]))
    for i in (5, 60):
        own = Counter(zip(words[i], words[i][1:]))
        pmi = sum(h * np.log(max(double[p] - h, 0.5) * sum(single.values()) / single[p[0]] / single[p[1]]) for p, h in own.items() if double[p] > 1) / (len(words[i]) - 1)
        assert any(r[0] == i // 2 and r[2] == pytest.approx(pmi) for r in whole)


def test_fragments_by_hand():
    found = stuffing.Batch(["rea, skor och mer\nen hel mening utan tecken", "www.a.example/x - b.example", "", "a\x01b \x02 c"], marks=True)
    assert found.fragments.tolist() == pytest.approx([4 / 9, 1, 0, 1]) and found.sizes.tolist() == [9, 2, 0, 3] and found.link_share[1] > 0.8


def test_mutual_information_decides_the_pages(spark):
    """Without it (excess and mean_pmi at the corpus's middle) no page is found, so all true pages come through the named method."""
    rows = [(i, PROSE) for i in range(30)] + [(100 + i, " ".join(["billig matta"] * 20)) for i in range(3)]
    pages = stuffing.page_features(spark.createDataFrame(rows, "id bigint, t string"), "id", "t").toPandas()
    assert (pages[pages.id >= 100].score > stuffing.WHOLE).all() and (pages[pages.id < 100].score.abs() < stuffing.LOOSE).all()


def test_pages_of_odd_rows(odd, empty):
    assert stuffing.page_features(odd, "id", "t").count() == len(ODD)
    assert stuffing.spam_pages(empty, "id", "t").count() == 0


# --- reading level ------------------------------------------------------------------------------------------------------------


def test_reading_levels(spark, known):
    easy = "Vi såg en hund. Den bor här. Vi gick ut. Det var bra. Han fick mat. Alla mår bra nu. "
    usual = "Studien bygger på intervjuer med lärare och föräldrar i kommunen. Resultatet visar att samverkan mellan skolan och hemmet fungerar bättre än väntat i vardagen. "
    hard = "Institutionaliseringsprocesserna förstås utifrån epistemologiska begreppsbildningar kring ansvarsfördelningen, varvid kunskapsproduktionen legitimerar organisationsteoretiska handlingsutrymmen inom professionaliseringssträvandena, medan värderingsgrunderna differentierar implementeringsförutsättningarna i samverkansstrukturerna såvida inte kompetensförsörjningen problematiseras. "
    rows = [(i, usual + f"Arbetet nummer {'abcdefghij'[i % 10] * 5} kom till i höstas och det gick bra. " * (1 + i % 3)) for i in range(60)]
    rows += [(100, easy * 2), (101, hard * 2), (102, hard + "\nNyckelord: hund, katt, mat"), (103, "We collected answers from many people and the results show that it is hard to know what they want from us."), (104, None), (105, " "), (106, "nan")]
    got = {r["row_id"]: r["level"] for r in reading.reading_levels(spark.createDataFrame(rows, "row_id bigint, Abstract string"), "row_id", "Abstract", known).collect()}
    assert {k: got[k] for k in range(100, 107)} == {100: "easy", 101: "hard", 102: "hard", 103: "other", 104: "none", 105: "none", 106: "none"}
    assert {got[i] for i in range(60)} == {"ordinary"}


def simulated(spark, n=400, seed=4):
    """Documents drawn from the model itself: levels, difficulties of 60 words of all lengths, sentence lengths by the same model."""
    rng = np.random.default_rng(seed)
    words = [c * k for k in range(1, 13) for c in "abcde"]
    hard = np.array([0.25 * (len(w) - 6) for w in words])
    theta, tau = rng.normal(0, 1, n), rng.normal(0, 1, n)
    rows = []
    for i in range(n):
        p = np.exp(theta[i] * hard)
        text = []
        for _ in range(12):
            k = 1
            while k < 30 and rng.random() < 1 / (1 + np.exp(-1.0 - tau[i])):
                k += 1
            text.append(list(rng.choice(words, k, p=p / p.sum())))
        rows.append((i, [pairs for s in text for pairs in s], [len(s) for s in text]))
    coded = [(i, reading.codes_of([w])[0].tolist(), s) for i, w, s in rows]
    return spark.createDataFrame(coded, "id bigint, codes array<bigint>, sentences array<int>"), theta, tau


def test_levels_and_difficulties_come_back(spark):
    """Levels and difficulties of simulated documents are recovered, and the rounds raise the likelihood's fit over the length prior."""
    texts, theta, tau = simulated(spark)
    words, stops = reading.fit(texts)
    rows = sorted(texts.collect(), key=lambda r: r["id"])
    items = reading.items_of(np.array([c for r in rows for c in r["codes"]], np.int64), words.known)
    offsets = np.concatenate([[0], np.cumsum([len(r["codes"]) for r in rows])])
    reach, on = reading.steps(np.array([x for r in rows for x in r["sentences"]]), np.concatenate([[0], np.cumsum([12] * len(rows))]))
    assert np.corrcoef(words.levels(items, offsets), theta)[0, 1] > 0.9 and np.corrcoef(reading.sentence_levels(reach, on, stops), tau)[0, 1] > 0.9
    at = words.levels(items, offsets)
    expected = np.interp(at, reading.LEVELS, words.mean) * np.diff(offsets) + at
    assert expected == pytest.approx(letters.segment_sums(words.difficulty[items], offsets), abs=0.05)


def test_rare_words_share_a_difficulty_and_codes_hold_the_length():
    codes, offsets = reading.codes_of([["hund", "hund"], [], ["å" * 40]])
    assert offsets.tolist() == [0, 2, 2, 3] and codes[0] == codes[1] and (codes & reading.LONGEST).tolist() == [4, 4, 31]
    assert reading.items_of(codes, codes[:1]).tolist() == [0, 0, 1 + 31] and reading.items_of(codes, codes[:0]).tolist() == [4, 4, 31]


def test_sentences_and_short_forms():
    assert reading.sentence_count(reading.body("Det gäller bl.a. hundar, t.ex. taxar. Slut!\n\nNyckelord: a. b.")) == 2


def test_levels_of_odd_rows(odd, empty, known):
    assert reading.reading_levels(odd, "id", "t", known).count() == len(ODD)
    assert reading.reading_levels(empty, "id", "t", known).count() == 0


# --- pairs --------------------------------------------------------------------------------------------------------------------

QUESTION = "Hej! Har ni tips på en bra cykel för långa turer? Tack på förhand!"
ANSWER = "Jag skulle välja en cykel med breda däck. Det beror på hur långt du ska åka. Prata med någon i butiken först."


def test_defects(spark, known):
    rows = [(i, QUESTION, ANSWER) for i in range(80)]
    cases = {
        200: ("-", "empty"), 201: (None, "empty"), 202: ("​", "empty"), 203: ("[tomt svar]", "empty"), 204: ("Tyvärr kan jag inte hjälpa till med den här begäran.", "refusal"), 205: ("I'm sorry, but I can't help with that request.", "refusal"),
        206: ("HEJ HAR NI TIPS PÅ EN BRA CYKEL FÖR LÅNGA TURER?? tack på förhand", "copy"), 207: ("Fråga: " + QUESTION, "copy"), 208: ("I do not know what is best. The results show that this is hard, but it does not cost much to try.", "language"),
        209: ("Jag skulle välja en cykel med breda däck. Det beror på hur långt du", "truncated"), 210: (ANSWER[:-1], None), 211: ("> " + QUESTION + "\n\n" + ANSWER, None), 212: ("Jag kan inte hjälpa att jag gillar breda däck. " + ANSWER, None), 213: (ANSWER[:-1] + " :)", None),
    }
    rows += [(k, QUESTION, a) for k, (a, _) in cases.items()] + [(300, None, ANSWER), (301, "", "")]
    got = {r["id"]: r["defect"] for r in pairs.find_defects(spark.createDataFrame(rows, "id bigint, q string, a string"), "id", "q", "a", "informal", known).collect()}
    assert {k: got.get(k) for k in cases} == {k: d for k, (_, d) in cases.items()}
    assert got.get(300) is None and got[301] == "empty" and not set(got) & set(range(80))


def test_ends_are_counted_in_all_answers(spark, known):
    """Six sentences among 60,000 answers tell that an answer may end so; a sample of them has too few."""
    rows = spark.range(60_000).select("id", F.lit(QUESTION).alias("q"), F.when(F.col("id") % 10_000 == 7, "Kolla gärna vinterdäcken. Det är bra.").otherwise("Det är bra.").alias("a"))
    asked = spark.createDataFrame([(70_000, QUESTION, "Det är bra. Kolla gärna vinterdäcken"), (70_001, QUESTION, "Det är bra. Kolla gärna")], rows.schema)
    got = pairs.find_defects(rows.unionAll(asked), "id", "q", "a", "informal", known).collect()
    assert [(r["id"], r["defect"]) for r in got] == [(70_001, "truncated")]


def test_verdicts_do_not_depend_on_length():
    """Long refusals, refusals behind a long greeting, and late sentences that only sound like one."""
    no = "Tyvärr kan jag inte hjälpa till med den här begäran. "
    assert pairs.is_refusal(no + ANSWER * 40) and pairs.is_refusal("Hej " + "och tack " * 200 + "för frågan! " + no) and not pairs.is_refusal(ANSWER * 40 + no)
    assert pairs.open_end(ANSWER + " Det beror på " + "väldigt " * 300 + "mycket annat")[-3:] == ["väldigt", "mycket", "annat"]


def test_copied_titles_and_keywords():
    title, keys = "Vägar till samverkan: En studie av lärare", "tillit; kontroll"
    assert pairs.is_copy(title, keys, "vägar till samverkan - en studie av lärare. Nyckelord: tillit, kontroll")
    assert pairs.is_copy(title, "", "tillit, kontroll, lärande. " + title)
    assert not pairs.is_copy(title, keys, title + ". Studien handlar om hur lärare arbetar tillsammans i vardagen.")
    assert not pairs.is_copy("", keys, "något helt annat")


def test_language_posteriors(known):
    p = languages.posteriors(["Det är inte så lätt att veta.", "It is not that easy to know the results.", ""], known)
    assert [languages.LANGUAGES[i] for i in p.argmax(1)[:2]] == ["sv", "en"] and p.sum(1) == pytest.approx([1, 1, 1])


def test_pairs_of_odd_rows(odd, empty, known):
    assert {r["defect"] for r in pairs.find_defects(odd, "id", "kind", "t", "x", known).filter("id < 4").collect()} == {"empty"}
    assert pairs.find_defects(empty, "id", "t", "t", "x", known).count() == 0


# --- personal information -----------------------------------------------------------------------------------------------------

HELD_OUT = [
    ("Du kan maila lisa.andersson@foretag.example eller ringa 08-465 004 12.", {"email", "phone"}), ("Mitt personnummer är 850709-9805, det räcker.", {"id_number"}), ("Mitt personnummer är 850709-9806, det räcker.", set()),
    ("Vi flyttade till Storgatan 14 B i våras.", {"address"}), ("Vi gick hela Storgatan fram.", set()), ("Jag heter Gunnar Ekström.", {"name"}), ("Det var Vera som hjälpte mig.", {"name"}), ("Vi såg en björn i skogen.", set()), ("Björn Ekström hjälpte mig.", {"name"}),
    ("skriv till kalle snabel-a post punkt example", {"email"}), ("@gunnar skrev det först", set()), ("Fakturan på 12 500 300 kr kom den 2014-03-01.", set()), ("Ring noll sju noll ett sju fyra noll sex ett fyra i kväll", {"phone"}), ("", set()),
]


def test_personal_information_on_held_out_sentences():
    model = personal.trained()
    got = [{k for _, _, k in g} for g in personal.find([t for t, _ in HELD_OUT], model)]
    assert [(t, w, g) for (t, w), g in zip(HELD_OUT, got) if w != g] == []


def scored(model, lines):
    """(right, all) of the marked kinds per document that are found, and how many are found without being marked."""
    right = whole = wrong = 0
    parsed = [personal.parse(line, 0) for line in lines]
    for (text, own), got in zip(parsed, personal.find([t for t, _ in parsed], model)):
        marked = {personal.LABELS[s.label] for s in own} - {"none"}
        found = {k for *_, k in got}
        right, whole, wrong = right + len(marked & found), whole + len(marked), wrong + len(found - marked)
    return right, whole, wrong


def test_chain_and_skip_links_decide():
    """On documents of another seed nearly all is found; without the pair potentials more than a third of it is lost."""
    model, lines = personal.trained(), personal.documents(sorted(personal.NAMES), 600, seed=77)
    right, whole, wrong = scored(model, lines)
    assert right > 0.95 * whole and wrong < 0.02 * whole
    alone = scored(personal.Crf(model.index, model.unary, np.zeros_like(model.pair)), lines)[0]
    assert alone < 2 / 3 * right


#: Shapes that the generator has no frame for.
OTHER_SHAPES = [
    ("I går ringde Gunilla Hedberg och klagade.", {"name"}), ("Fråga efter Lars-Erik eller Kerstin i receptionen.", {"name"}), ("Bor ni kvar i huset vid Stationsvägen 7?", {"address"}), ("Nytt nummer från måndag: 0737-12 34 56.", {"phone"}),
    ("Hon har kvar 08-123 456 78 som jobbnummer.", {"phone"}), ("Vet någon vem 19850709-9805 är?", {"id_number"}), ("Skicka kvittot till ekonomi@bolaget.example senast fredag.", {"email"}), ("Priset steg från 12 500 till 13 750 kr på 3 år.", set()),
    ("Björnen och stenen är två böcker.", set()), ("Vi tog E4 norrut i 40 mil och sedan väg 23.", set()), ("En saga om en sten, läst av en björn.", set()), ("ISBN 978-91-7429-123-4 är slutsåld.", set()),
]


def test_personal_information_in_other_shapes():
    got = [{k for *_, k in g} for g in personal.find([t for t, _ in OTHER_SHAPES], personal.trained())]
    assert sum(w == g for (_, w), g in zip(OTHER_SHAPES, got)) >= len(OTHER_SHAPES) - 1, [(t, w, g) for (t, w), g in zip(OTHER_SHAPES, got) if w != g]


def test_skip_links_carry_a_name():
    """A later mention without any sign of its own follows the sure one; without the skip potentials it does not."""
    model = personal.trained()
    text = "Hon heter Tuulikki. Vi väntade länge på besked. Sen kom tuulikki hem."
    assert personal.redact(text, personal.find([text], model)[0]) == "Hon heter [NAMN]. Vi väntade länge på besked. Sen kom [NAMN] hem."
    pair = model.pair.copy()
    pair[personal.SAME :] = 0
    assert "Sen kom tuulikki hem" in personal.redact(text, personal.find([text], personal.Crf(model.index, model.unary, pair))[0])


def test_spellings_that_the_patterns_take_are_searched():
    texts = ["skriv till kalle(a)example.se", "Ring plus fyra sex åtta fyra fem ett två tre", "Ring sju-sju-ett-två-tre-fyra-fem", "Ring fyra, fem, ett, två, tre, sex, åtta"]
    assert [[k for *_, k in f] for f in personal.find(texts, personal.trained())] == [["email"], ["phone"], ["phone"], ["phone"]]


def test_mentions_of_a_name_that_only_a_cue_shows():
    texts = ["Hon heter Tuulikki. Sen kom tuulikkis bror och TUULIKKI själv hem. Vi såg Tuulikki sen.", "Handläggaren Dag Ekström svarade. En dag och natt gick. I dag är det bra."]
    got = [personal.redact(t, f) for t, f in zip(texts, personal.find(texts, personal.trained()))]
    assert got == ["Hon heter [NAMN]. Sen kom [NAMN] bror och [NAMN] själv hem. Vi såg [NAMN] sen.", "Handläggaren [NAMN] svarade. En dag och natt gick. I dag är det bra."]


def test_personal_of_odd_rows(odd, empty):
    got = {r["id"]: r for r in personal.redact_texts(odd, "id", "t").collect()}
    assert got[1]["redacted"] is None and got[2]["redacted"] == "" and got[4]["redacted"] == PROSE and list(got[1]["kinds"]) == []
    assert personal.personal_kinds(empty, "id", "t").count() == 0


def test_very_long_texts_take_linear_time():
    import time

    model = personal.train(steps=20)
    long = ["a" * 200_000 + " @ x", "Anna Berg " * 20_000, "anna@post.example Anna " * 8_000, "070-123 45 67 " * 10_000, ("Ord " * 5 + ". ") * 8_000]
    began = time.perf_counter()
    got = personal.find(long, model)
    assert time.perf_counter() - began < 30 and len(got) == 5


def test_number_checks():
    assert personal.is_id("811218-9876") and personal.is_id("19811218 9876") and not personal.is_id("811318-9876")
    assert personal.is_phone("+46 (0)70-1740663") and personal.is_phone("0046701740663") and not personal.is_phone("556633-7215")


def test_trigrams():
    codes, offsets = letters.coded(["abc", "", "åäö"])
    assert offsets.tolist() == [0, 4, 5, 9] and letters.grams(codes)[0] == (1 << 10) + (2 << 5) + 3


def test_queries_are_listed(spark, sf):
    import __spark_entry__ as entry

    named = entry.queries()
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 9)} | {"p7_ids", "p8_mix"} <= set(named)
    assert named["p1_found"](spark, sf).filter(F.col("kind").isNull()).count() == 0
