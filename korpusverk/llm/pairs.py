"""Broken prompt and response pairs.

Method: language posteriors of prompt and response from character trigram naive Bayes; truncation from the likelihood, by backing-off
n-grams, that a text ends after its last words. Empty answers, refusals and copies are recognised by their form.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusverk.llm import languages
from korpusverk.plans.runtime import clash_free, cut

#: Words and contexts with fewer hits in all answers count as unknown.
LEAST = 4
#: Sentences with which a refusal begins: greetings and thanks may precede it.
OPENING = 3
#: Words with a smaller share of all words count as unknown too, so never more than so many are known.
SHARE = 1 << 22
#: Places of the bit set that keeps contexts with which no open answer ends out of the shuffle; a false hit costs time only.
PLACES_BITS = 26
#: Texts whose last words end a sentence with less than this probability are cut off.
CUT_OFF = 0.03
#: Least log-likelihood gap, for prompt and for response, between the best languages.
SURE = 4.0

#: Stand-ins for a missing answer, as letters and digits in lower case.
STAND_INS = frozenset("null nan na none nil tomtsvar tomt ingetsvar svarsaknas saknas empty noanswer deleted removed borttaget raderat error undefined tbd todo".split())
#: How a model declines, by language.
REFUSALS = re.compile(
    r"""som\ (?:en\ )?(?:ai|språkmodell|ai-assistent)\b.{0,30}\b(?:inte|avstå)|(?:jag\ (?:kan|bör|får|vill|tänker|skulle)\ |(?:kan|bör|får|vill|tänker|skulle)\ (?:\w+\ )?jag\ )(?:dessvärre\ |tyvärr\ |helst\ |därför\ )*inte\ (?:hjälpa\ (?:till|dig|er|med)|skriva|bistå|uppfylla|framställa|göra\ en\ text|formulera|låtsas|ta\ fram|besvara|producera|generera|utföra|leverera)
    |avstå(?:r)?\ från\ att\ (?:hjälpa|skriva|bistå|uppfylla|framställa|göra\ en|formulera|låtsas|ta\ fram|besvara|producera|svara)|(?:säga|tacka)\ nej\ till\ att\ (?:hjälpa|skriva|bistå|uppfylla|framställa|göra\ en|formulera|låtsas|ta\ fram|besvara|producera|svara)
    |inte\ möjlighet\ att\ (?:hjälpa|skriva|bistå|uppfylla|framställa|göra\ en|formulera|låtsas|ta\ fram|besvara|producera|svara)|inte\ för\ mig\ att\ (?:hjälpa|skriva|bistå|uppfylla|framställa|göra\ en|formulera|låtsas|ta\ fram|besvara|producera|svara)
    |rädd\ att\ jag\ inte\ kan\ |utanför\ vad\ jag\ (?:får|kan|bör)|(?:begäran|innehållet|texten|förfrågan|önskemålet)\ kan\ inte\ (?:behandlas|genereras|besvaras|uppfyllas|skrivas|tas\ fram)|av\ etiska\ skäl\ (?:lämnas|kan|får|ges)
    |bidrar\ jag\ inte\ till|tar\ jag\ inte\ fram|skriver\ jag\ inte\b|vore\ vilseledande|inget\ som\ går\ att\ besvara|enligt\ gällande\ riktlinjer|mot\ mina\ riktlinjer
    |\bi(?:\ am|'m|’m)\ (?:sorry,?\ but|unable\ to|not\ able\ to|afraid\ i\ can)|\bi\ (?:cannot|can't|can’t|can\ not|won't|won’t|will\ not)\ (?:be\ able\ to\ )?(?:assist|help|write|comply|produce|generate|create|fulfil|provide|do\ that)|as\ an?\ (?:ai\b|large\ language|language\ model)
    |must\ decline|have\ to\ (?:pass|decline)\b|against\ my\ guidelines|unable\ to\ (?:comply|assist|help\ with)
    |(?:kann|darf|möchte)\ ich\ (?:leider\ )?(?:nicht|keinen?)\b.{0,60}(?:schreiben|helfen|verfassen|erstellen|text)|ich\ (?:kann|darf)\ (?:\w+\ ){0,4}(?:leider\ )?nicht\ (?:\w+\ ){0,3}(?:helfen|schreiben|verfassen)|als\ (?:ki|sprachmodell)\b
    |(?:kan|må)\ jeg\ (?:dessverre\ |desværre\ )?(?:ikke|avstå)\ (?:hjelpe|hjælpe|skrive|bistå|lage|lave)|jeg\ kan\ (?:dessverre\ |desværre\ )?ikke\ (?:hjelpe|hjælpe|skrive|bistå|lage|lave)|som\ (?:en\ )?(?:språkmodell|sprogmodel)\b
    |en\ (?:valitettavasti\ )?voi\ (?:auttaa|kirjoittaa|tuottaa|toteuttaa)|kielimallina|tekoälynä""",
    re.I | re.X | re.S,
)
LABELS = re.compile(r"^(?:fråga|frågan|du frågar|du undrar|du skrev|titel|title|question|ämne|rubrik|citat|svar|q|nyckelord|keywords)\s*:", re.I | re.M)
FOOTER = re.compile(r"\s*\n?\s*(?:\*\*)?(?:nyckelord|keywords|ämnesord|sökord)(?:\*\*)?\s*:.*\Z", re.I | re.S)
#: Without one of these there is no footer.
KEYWORDS = re.compile("nyckelord|keywords|ämnesord|sökord", re.I)
TRAIL = re.compile(r"(?:\s*(?:[\U0001F000-\U0001FAFF☀-➿️‍]+|[:;]-?[)(DPp/|]|x[dD]|\bhaha\b|\blol\b|<3|[*_\"”»')\]]+))+\s*\Z")
SENTENCE = re.compile(r"[^.!?…\n]+(?:[.!?…]+|\n|\Z)")
WORD = re.compile(r"[^\W_]+")
WORDS = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*|[(,;:–-]")
PARTS = re.compile(WORDS.pattern + r"|[.!?…\n]")


def canonical(text: str) -> str:
    return "".join(c for c in text.lower() if c.isalnum())


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    form = canonical(answer)
    return not form and not re.search(r"[\U0001F000-\U0001FAFF]", answer) or form in STAND_INS


def is_refusal(answer: str) -> bool:
    """One of the first sentences declines, however long they and the rest are."""
    sentences = (x for x in re.split(r"(?<=[.!?…])\s+|\n", answer) if x.strip())
    return bool(REFUSALS.search(" ".join(" ".join(islice(sentences, OPENING)).split())))


def only_keywords(rest: str) -> bool:
    """Nothing but a list of short phrases, with or without its label."""
    items = [WORD.findall(x) for x in re.split(r"[,;\n.]", LABELS.sub("", rest))]
    items = [x for x in items if x]
    return len(items) >= 2 and all(len(x) <= 3 for x in items)


def is_copy(prompt: str, keywords: str | None, answer: str) -> bool:
    """The answer is only the prompt, once or more, in any formatting, with or without labels and keywords.

    keywords: None where prompts have none; a title's keywords may also stand in the answer alone.
    """
    q = canonical(prompt)
    if len(q) < 4:
        return False
    a = canonical(LABELS.sub("", answer.replace(">", "").replace('"', "")))
    if q in a:
        rest = a.replace(q, "")
        for k in sorted((canonical(x) for x in re.split(r"[;,]", keywords or "")), key=len, reverse=True):
            rest = rest.replace(k, "") if k else rest
        for label in ("nyckelord", "keywords", "fråga", "titel", "duundrar", "dufrågar", "haha"):
            rest = rest.replace(label, "")
        if len(rest) <= 8 or keywords is None:
            return len(rest) <= 8
        title = r"[\W_]+".join(map(re.escape, re.findall(r"[^\W_]+", prompt)))
        return only_keywords(re.sub(title, "\n", answer, flags=re.I))
    own = {canonical(s) for s in SENTENCE.findall(prompt)} - {""}
    got = [canonical(s) for s in SENTENCE.findall(LABELS.sub("", answer))]
    got = [g for g in got if g]
    return bool(got) and len("".join(got)) >= 0.5 * len(q) and all(g in own for g in got)


def body(text: str) -> str:
    """The text without a list of keywords at its end."""
    return FOOTER.sub("", text) if KEYWORDS.search(text) else text


def open_end(answer: str) -> list[str] | None:
    """The last words, in lower case, of an answer without a final mark; None where the form shows that it is whole."""
    whole = body(answer).rstrip()
    bare = TRAIL.sub("", whole)
    if not bare or re.search(r"[.!?]\Z", bare) and not re.search(r"\.{2,}\Z", bare):
        return None
    if whole != bare and re.search(r"[.!?][\"”»')\]]*\Z", whole):
        return None
    return WORDS.findall(re.sub(r"[.…\s]+\Z", "", bare).lower()) or None


def word_codes(words: Iterable[str]) -> np.ndarray:
    return pd.util.hash_array(np.array([*words], dtype=object), categorize=False)


NUMBER, UNKNOWN = word_codes("#~")


def form_codes(words: Iterable[str], known: np.ndarray) -> np.ndarray:
    """64-bit codes of words; numbers count as #, words that are not among the sorted codes of known as ~."""
    codes = word_codes(words)
    at = np.searchsorted(known, codes)
    codes[known[np.minimum(at, len(known) - 1)] != codes if len(known) else slice(None)] = UNKNOWN
    codes[[w.isdigit() for w in words]] = NUMBER
    return codes


def context_keys(*codes: np.ndarray) -> np.ndarray:
    """Keys of contexts from the codes of their words, the oldest first."""
    key = np.full_like(codes[0], len(codes))
    for c in codes:
        key = (key ^ c) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def count_words(df: DataFrame, column: str) -> DataFrame:
    """(word, n) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = Counter(w for t in batch.column(0).to_pylist() if t for w in WORDS.findall(body(t).lower()))
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["word", "n"])

    return df.select(column).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def known_codes(words: DataFrame) -> np.ndarray:
    """Sorted codes of the words with LEAST hits and 1/SHARE of all hits or more: 8 bytes a word, at most 32 MB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(word_codes(batch.column(0).to_pylist()).view(np.int64))], names=["code"])

    total = words.agg(F.sum("n")).first()[0] or 0
    rows = words.filter(F.col("n") >= max(LEAST, total / SHARE)).select("word").mapInArrow(run, "code bigint").toArrow()
    return np.sort(rows.column(0).to_numpy().view(np.uint64))


def place_filter(keys: DataFrame) -> np.ndarray:
    """A fixed-size bit set with the places of all keys."""
    place = F.pmod("key", F.lit(1 << PLACES_BITS)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).toArrow()
    out = np.zeros((1 << PLACES_BITS) // 8, np.uint8)
    for part, bits in zip(parts["part"].to_pylist(), parts["bits"].to_pylist()):
        out[(part - 1) * len(bits) : part * len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def context_counts(texts: list[str], known: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, hits, hits at a sentence's end) of the one- to three-word contexts within sentences that places lets through.

    The last word of a sentence without a final mark is no hit, as nothing tells whether a sentence could end there.
    """
    parts = PARTS.findall("\n".join(map(body, texts)).lower() + "\n")
    at, forms = pd.factorize(np.array(parts, dtype=object))
    mark = np.array([w in ".!?…\n" for w in forms])[at]
    final = np.array([w in ".!?…" for w in forms])[at]
    codes = form_codes(forms, known)[at]
    follows, ends = np.append(mark[1:], True), np.append(final[1:], False)
    hit = ~mark & (~follows | ends)
    keys, last = [], []
    for k in (1, 2, 3):
        i = np.flatnonzero(hit[k - 1 :]) + k - 1
        for back in range(1, k):
            i = i[~mark[i - back]]
        key = context_keys(*(codes[i - back] for back in range(k - 1, -1, -1)))
        place = key & ((1 << PLACES_BITS) - 1)
        some = (places[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        keys.append(key[some])
        last.append(ends[i][some])
    found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(inverse, minlength=len(found)), np.bincount(inverse, np.concatenate(last), len(found)).astype(np.int64)


def end_probabilities(df: DataFrame, column: str, known: np.ndarray, keys: DataFrame) -> DataFrame:
    """(key, p): P(a sentence ends after the context) from the contexts of all rows, for those of keys that have LEAST hits or more."""
    shared = df.sparkSession.sparkContext.broadcast((known, place_filter(keys)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            for at in range(0, len(texts), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in context_counts(texts[at : at + 1000], *shared.value)], names=["key", "n", "ends"])

    counts = df.select(column).mapInArrow(run, "key bigint, n bigint, ends bigint").groupBy("key").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    return cut(counts.filter(F.col("n") >= LEAST).select("key", ((F.col("ends") + 0.1) / (F.col("n") + 1.0)).alias("p")))


def broken_words(words: DataFrame, asked: DataFrame) -> DataFrame:
    """(word, broken) of the asked unknown words: it begins a known word, or its last three letters seldom end the unknown words that hold them."""
    size = F.length("word")
    rare = words.filter(F.col("n") < LEAST)
    inner = rare.filter(size >= 3).select(F.explode(F.expr("transform(sequence(3, length(word)), i -> struct(substring(word, i - 2, 3) AS tail, 1 AS core, int(i = length(word)) AS ends))")).alias("x")).select("x.*")
    brief = rare.filter(size < 3).select(F.col("word").alias("tail"), F.lit(0).alias("core"), F.lit(1).alias("ends"))
    shapes = inner.unionAll(brief).groupBy("tail").agg(((F.sum("ends") + 0.05) / (F.sum("core") + 1.0)).alias("whole"))
    starts = words.filter((F.col("n") >= LEAST) & (size >= 3)).select(F.explode(F.expr("transform(sequence(2, length(word) - 1), i -> substring(word, 1, i))")).alias("word")).distinct().withColumn("start", F.lit(True))
    tailed = asked.distinct().withColumn("tail", F.when(size >= 3, F.substring("word", -3, 3)).otherwise(F.col("word")))
    return tailed.join(shapes, "tail", "left").join(starts, "word", "left").select("word", (F.col("start").isNotNull() | (F.coalesce("whole", F.lit(0.05)) < 0.3)).alias("broken"))


def find_defects(df: DataFrame, id_col: str, prompt: str, answer: str, register: str, language_table: np.ndarray, keywords: str | None = None, names: tuple = languages.LANGUAGES) -> DataFrame:
    """(register, id, defect) of the defective pairs, at most one defect each: empty, refusal, copy, language or truncated, in this order.

    A null prompt cannot be copied and has no language. Repeated rows are judged one by one; an empty table gives an empty result.
    Three passes over whole texts: the words of all answers, the verdicts with the last words of the answers that have no final mark, and
    how often a sentence ends after those words in all answers. P(end) is the higher of the two- and three-word contexts, else of the last word.
    """
    src = clash_free(df, id_col, prompt, answer, *([keywords] if keywords else []))
    words = cut(count_words(src, answer))
    known = known_codes(words)
    shared = df.sparkSession.sparkContext.broadcast((known, language_table))
    same = np.array([2 if n == "da" else k for k, n in enumerate(names)]) if "da" in names and names[2] == "no" else np.arange(len(names))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, table = shared.value
        for f in frames:
            qs, xs = ([x if isinstance(x, str) else None for x in f[c]] for c in (prompt, answer))
            ks = [x if isinstance(x, str) else "" for x in f[keywords]] if keywords else [None] * len(f)
            sq, sa = (best(languages.scores([t or "" for t in ts], table), same) for ts in (qs, xs))
            found, odd = [], [None] * len(f)
            keys = [[None] * len(f) for _ in range(3)]
            for i, (q, a, k, (lq, gq), (la, ga)) in enumerate(zip(qs, xs, ks, sq, sa)):
                if is_empty(a):
                    found.append("empty")
                elif is_refusal(a):
                    found.append("refusal")
                elif is_copy(q or "", k, a):
                    found.append("copy")
                elif lq != la and gq > SURE and ga > SURE and q:
                    found.append("language")
                elif not (last := open_end(a)):
                    found.append(None)
                elif last[-1] in "(,;:–-":
                    found.append("truncated")
                else:
                    found.append(None)
                    codes = form_codes(last[-3:], known)
                    odd[i] = last[-1] if codes[-1] == UNKNOWN else None
                    for n, column in enumerate(keys, 1):
                        column[i] = int(context_keys(*codes[-n:].reshape(-1, 1))[0])
            out = pd.DataFrame({"register": register, id_col: f[id_col], "defect": found, "_odd": odd, **{f"_key{n}": pd.array(column, dtype="Int64") for n, column in enumerate(keys, 1)}})
            yield out[out["defect"].notna() | out["_key1"].notna()]

    found = cut(src.mapInPandas(run, f"register string, `{id_col}` {src.schema[0].dataType.simpleString()}, defect string, _odd string, _key1 bigint, _key2 bigint, _key3 bigint"))
    ends = end_probabilities(src, answer, known, found.filter("_key1 IS NOT NULL").select(F.explode(F.array("_key1", "_key2", "_key3")).alias("key")))
    broken = broken_words(words, found.filter("_odd IS NOT NULL").select(F.col("_odd").alias("word")))
    judged = found.filter("_key1 IS NOT NULL").join(broken.withColumnRenamed("word", "_odd").withColumnRenamed("broken", "_broken"), "_odd", "left")
    for n in (1, 2, 3):
        judged = judged.join(ends.select(F.col("key").alias(f"_key{n}"), F.col("p").alias(f"_p{n}")), f"_key{n}", "left")
    p_end = F.when(F.col("_broken"), 0.0).otherwise(F.coalesce(F.greatest("_p2", "_p3"), F.col("_p1"), F.lit(0.02)))
    cut_off = judged.filter(p_end < CUT_OFF).withColumn("defect", F.lit("truncated"))
    return found.filter("_key1 IS NULL").select("register", f"`{id_col}`", "defect").unionAll(cut_off.select("register", f"`{id_col}`", "defect"))


def best(s: np.ndarray, same: np.ndarray) -> list[tuple[int, float]]:
    """(language group, log-likelihood gap to the best other group) of each row."""
    groups = np.unique(same)
    by = np.stack([s[:, same == g].max(1) for g in groups], axis=1)
    order = np.sort(by, axis=1)
    return list(zip(groups[by.argmax(1)].tolist(), (order[:, -1] - order[:, -2]).tolist()))
