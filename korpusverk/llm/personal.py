"""Personal information inside free text.

Method: a skip-chain conditional random field over tokens. Nodes are the tokens that can belong to personal information: mailboxes, groups of digits, spelled-out
digits, street words, names and capitalised words, and what stands beside them. A node's own features tell little: a group of digits, a street or a
surname alone is nothing. Neighbouring nodes share chain potentials that depend on what stands between them, and distant nodes of the same form, or a
mailbox and a name like it, share skip potentials; loopy message passing over both enforces consistent labels across the document. All weights,
those of the skip links too, are fitted by likelihood on generated documents. Date, check digit and length checks follow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusverk.llm.training_sentences import documents
from korpusverk.plans.runtime import clash_free

LABELS = ("none", "email", "phone", "id_number", "address", "name")
PLACES = {"email": "[E-POST]", "phone": "[TELEFON]", "id_number": "[PERSONNUMMER]", "address": "[ADRESS]", "name": "[NAMN]"}

#: Frequent given names in Sweden, in lower case.
NAMES = frozenset(
    """agneta albin alexander alice alma amanda amina amir anders anita anna annika ann-sofi ann-sofie ann-marie anton arne arvid astrid axel barbro bengt berit bertil birgitta björn bo britt caroline
    carina cecilia charlotte christer christian claes dagmar daniel david dragan ebba edvin elias elin elisabeth ella elsa elvira emelie emil emma erik erika eva evelina fatima felix filip fredrik frida gabriel
    gerd gudrun gunilla gunnar gustav göran hanna hans harald hassan helena henrik hjalmar hugo ida inga ingela inger ingrid ingvar irene isak jakob jan jenny jesper joakim johan johanna john jonas josefin jörgen
    kajsa karin karl karl-erik katarina kenneth kerstin kjell klara klas kristina kurt lars lena lennart leyla liam linda linnea linus lisa lova lovisa lucas ludvig magnus maj maj-britt maja malin margareta maria marie
    marcus martin mats matilda mikael mohammed mona märta monica nils noah ola olivia olle olof oskar ove oscar patrik per pernilla peter petra pontus rasmus robin roger rolf ronja rune saga sandra sara sebastian
    signe simon siv sixten sofia sonja stefan sten stig stina susanne sven thomas tomas tobias torbjörn tove tuva ulf ulla vera viktor vilma wilma ylva yusuf zeinab åke åsa östen""".split()
)
#: Given names that are also everyday words.
EVERYDAY = frozenset("björn sten saga linnea siv stig bo per maj vera lova alma tove signe ola rune kajsa klara klas robin ebba hans mona".split())
SURNAME = re.compile(r"^\w{2,}(?:berg|ström|qvist|kvist|lund|gren|mark|dahl|dal|hielm|hjelm|sparr|stam|wall|vall|vret|sson|man|stedt|blad|ling|löf|feldt|holm|strand|ek|sköld|stål|borg|ius|én|in|ic|ovic|zadeh)s?$", re.I)
SURNAME = re.compile(r"^\w{2,}(?:berg|ström|qvist|kvist|lund|gren|mark|dahl|dal|hielm|hjelm|sparr|stam|wall|vall|vret|sson|man|stedt|blad|ling|löf|feldt|holm|strand|ek|sköld|stål|borg|ell|rud|ius|én|in|ic|ovic|zadeh)s?$")
#: Words that announce a person, follow one, or stand before and after everyday words of the same form.
BEFORE = frozenset("heter mvh hälsningar hälsning vänligen handläggaren handläggare enligt med såg granne grannen syster bror sambo kollega kollegan kompis kompisen fru maken hyresvärden chefen chef läkaren läraren rektor kallar".split())
INTRODUCED = frozenset("heter handläggaren enligt mvh hälsningar kallar".split())
AFTER = frozenset("som svarade tipsade bror syster mamma pappa sa säger skrev ringde visade har rekommenderade gav".split())
ARTICLES = frozenset("en ett den det de denna någon ingen lång liten stor av alla".split())
PLACE = frozenset("i från mot till på".split())
PLAIN_AFTER = frozenset("är finns blommar bakom det den dem oss sig och kan passar".split())
NUMBER_CUES = frozenset("ring ringa nummer numret tel tfn telefon telefonnummer mobil sms sms:a smsa signal nås når ringde växeln slå".split())
ID_CUES = frozenset("pnr personnummer personnr intyget registrerad född samordningsnummer journalen kortet uppgav".split())
OTHER_CUES = frozenset("organisationsnummer orgnr ordernummer artikelnumret artikelnummer kundnummer ärende ärendet ärendenummer version stod kl faktura fakturan kostade saldot".split())
STREET_CUES = frozenset("på till adress adressen bor låg grannen lägenheten paketet huset".split())
UNITS = frozenset("kr kronor sek st euro procent mil minuter dagar veckor år timmar gånger personer".split())
DIRECTIONS = frozenset("norra södra östra västra gamla nya stora lilla övre nedre".split())
DIGITS = frozenset("noll nolla ett en etta två tvåa tre trea fyra fem femma sex sexa sju sjua åtta nio nia plus".split())
STREET = re.compile(r"(?:gatan|gata|vägen|väg|stigen|stig|gränden|gränd|backen|backe|allén|allé|torget|torg|esplanaden|leden|kajen|plan|parken|stråket)$")
MAIL = re.compile(r"(?<![\w.+-])[\w.+-]*\w\s?(?:@|\(at\)|\[at\]|\{at\}|\ssnabel-?a\s|\(a\)|&#64;)\s?\w[\w-]*(?:\s?(?:\.|\[dot\]|\(dot\)|\(punkt\)|\spunkt\s)\s?\w[\w-]+)+", re.I)
MAIL_SIGNS = re.compile(r"@|snabel|\(at\)|\[at\]|\{at\}|\(a\)|&#64;", re.I)
HANDLE = re.compile(r"@\w+")
LETTERS = re.compile(r"[^\W\d_]{3,30}(?:-[^\W\d_]{1,20})?")
TOKEN = re.compile(r"\d+|[^\W\d_]+(?:-[^\W\d_]+)*(?::[^\W\d_]+)?")
#: Words after a cue that are no names.
NO_NAMES = frozenset("inget inte min mitt mina hans hennes din alla någon ingen svärfar svärmor mekanikern killen hon han en ett det den de jag du vi ring tack tel adress kontakt skicka maila edit uppdatering på till om".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(digits):
        v = int(c) * (2 - i % 2)
        total += v // 10 + v % 10
    return total % 10 == 0


def is_id(text: str) -> bool:
    """A Swedish personal or coordination number: a date (days from 61 on for the latter) and a right check digit."""
    m = re.fullmatch(r"\s*(?:18|19|20)?(\d{2})(\d{2})(\d{2})\s?[-+–]?\s?(\d{4})\s*", text)
    if not m:
        return False
    month, day = int(m[2]), int(m[3])
    return 1 <= month <= 12 and (1 <= day <= 31 or 61 <= day <= 91) and luhn(m[1] + m[2] + m[3] + m[4])


def is_phone(text: str) -> bool:
    digits = re.sub(r"\D", "", text)
    t = text.strip().lstrip("(")
    if t.startswith("+"):
        return 9 <= len(digits) <= 14
    if t.startswith("00"):
        return 11 <= len(digits) <= 15
    return t.startswith("0") and 8 <= len(digits) <= 11 and not re.match(r"0\d{5}[-+]\d{4}$", t)


class Node:
    __slots__ = ("start", "end", "kind", "doc", "at", "features", "key", "label")

    def __init__(self, start, end, kind, doc, at, key):
        self.start, self.end, self.kind, self.doc, self.at, self.key, self.features, self.label = start, end, kind, doc, at, key, (), 0


@lru_cache(1 << 17)
def form(word: str) -> tuple[str, str]:
    """(kind that a lower-case word has by itself, or nothing; its form without genitive s)."""
    base = word if word in NAMES or not word.endswith("s") else word[:-1]
    if word in DIGITS:
        return "digit", word
    if word == "nr":
        return "nr", word
    if len(word) == 1:
        return "letter", word
    if word in DIRECTIONS:
        return "direction", word
    if base in NAMES and not word.endswith("ss"):
        return "name", base
    if STREET.search(word) and word not in ("plan", "iväg", "förväg", "parken"):
        return "street", word
    return "", base


def mails(text: str) -> list[tuple[int, int, str]]:
    if not MAIL_SIGNS.search(text):
        return []
    found = [(m.start(), m.end(), "mail") for m in MAIL.finditer(text)]
    return sorted(found + [(m.start(), m.end(), "handle") for m in HANDLE.finditer(text) if all(m.end() <= a or b <= m.start() for a, b, _ in found)])


def nodes(text: str, doc: int = 0) -> list[Node]:
    """The tokens of the text that can belong to personal information, in order."""
    whole = mails(text)
    tokens, k = [], 0
    for m in TOKEN.finditer(text):
        a, b = m.span()
        while k < len(whole) and whole[k][1] <= a:
            tokens.append((*whole[k], ""))
            k += 1
        if k < len(whole) and whole[k][0] < b:
            continue
        parts = m.group().split("-")
        if len(parts) > 1 and all(p.lower() in DIGITS for p in parts):  # spelled-out digits joined by hyphens
            for p in parts:
                tokens.append((a, a + len(p), "", p))
                a += len(p) + 1
        else:
            tokens.append((a, b, "", m.group()))
    tokens += [(*w, "") for w in whole[k:]]
    low = [w.lower() for *_, w in tokens]
    letters = [w for w in low if w]
    mixed = 0 < sum(w[0].isupper() for *_, w in tokens if w) <= 0.6 * len(letters)
    upper = bool(letters) and text.isupper()
    kinds = []
    for i, (a, b, kind, w) in enumerate(tokens):
        if kind:
            kinds.append((kind, text[a:b].lower()))
            continue
        if w[0].isdigit():
            kinds.append(("num", w))
            continue
        kind, base = form(low[i])
        before = low[i - 1] if i else ""
        if kind == "digit" and not (kinds and kinds[-1][0] == "digit" or i + 1 < len(low) and low[i + 1] in DIGITS):
            kind = ""
        elif kind == "letter" and not (kinds and kinds[-1][0] in ("num", "name", "cap", "letter")):
            kind = ""
        elif kind == "name" and (text[b : b + 1] in ("+", "_") or text[a - 1 : a] in ("+", "_")):
            kind = ""
        elif not kind:
            if text[b : b + 1] == "." and low[i][-1] in "gv" and len(w) > 3 and i + 1 < len(low) and (low[i + 1][:1].isdigit() or low[i + 1] == "nr") and "\n" not in text[b : tokens[i + 1][0]]:
                kind = "street"
            elif kinds and kinds[-1][0] in ("name", "cap", "letter") and SURNAME.match(low[i]):
                kind = "cap"
            elif i + 1 < len(low) and SURNAME.match(low[i]) and form(low[i + 1])[0] == "name":
                kind = "cap"
            elif w[0].isupper() and mixed and low[i] not in NO_NAMES and not starts(text, a):
                kind = "cap"
            elif (before in INTRODUCED or text[max(0, a - 3) : a].rstrip(" ").endswith("/")) and (w[0].isupper()) and low[i] not in NO_NAMES:
                kind = "cap"
        kinds.append((kind, base))
    repeated = {base for kind, base in kinds if kind in ("cap", "name")}
    found = []
    for i, ((a, b, _, w), (kind, base)) in enumerate(zip(tokens, kinds)):
        if not kind and len(base) > 2 and base in repeated:
            kind = "cap"  # another mention
        if kind:
            found.append(Node(a, b, kind, doc, i, base))
    for s in found:
        s.features = tuple(features(text, s, tokens, low, mixed, upper))
    return found


def starts(text: str, at: int) -> bool:
    """A text, line or sentence begins at the place."""
    left = text[max(0, at - 4) : at].rstrip(" \"'”>*-(")
    return left[-1:] in ("\n", ".", "!", "?", ":", ";", "")


def features(text: str, s: Node, tokens: list, low: list[str], mixed: bool, upper: bool) -> list[str]:
    """What the node and the words around it show; nothing about the labels or kinds of its neighbours."""
    i, kind = s.at, s.kind
    l1, l2, l3 = (low[i - k] if i >= k else "^" for k in (1, 2, 3))
    r1 = low[i + 1] if i + 1 < len(low) else "$"
    gap = text[tokens[i - 1][1] : s.start] if i else "^"
    out = ["kind=" + kind]
    if kind in ("num", "digit"):
        near = (l1, l2, l3, low[i - 4] if i >= 4 else "^")
        out += [c for c, ws in (("call", NUMBER_CUES), ("idcue", ID_CUES), ("othercue", OTHER_CUES)) if any(x in ws for x in near)]
        if kind == "num":
            n, t = s.end - s.start, s.key
            out += [f"len={min(n, 13)}", *["zero"] * (t[0] == "0"), *["plus"] * (text[s.start - 1 : s.start] == "+"), *["unit"] * (r1 in UNITS), *["year"] * (n == 4 and t[:2] in ("19", "20"))]
            out += [f"len={min(n, 13)}+zero"] * (t[0] == "0") + ["date8"] * (n in (8, 12) and t[:2] in ("19", "20")) + ["date6"] * (n in (6, 10) and t[2:4] <= "12" and (t[4:6] <= "31" or "61" <= t[4:6] <= "91"))
        return out
    if kind == "street":
        out += ["short"] * (text[s.end : s.end + 1] == ".") + ["capital"] * text[s.start].isupper() + ["cue"] * (l1 in STREET_CUES or gap.strip() in (",", ":")) + ["bare"] * bool(STREET.fullmatch(s.key)) + ["plainbare"] * bool(STREET.fullmatch(s.key) and l1 not in STREET_CUES and not text[tokens[i - 1][0] if i else 0].isupper())
        return out
    if kind in ("mail", "handle", "nr", "direction"):
        return out
    title, base = text[s.start].isupper() and mixed, s.key
    first = starts(text, s.start)
    every, known = base in EVERYDAY, base in NAMES
    genitive = low[i] != base
    stroke = gap.rstrip(" ").endswith("/")
    before = (l1 in BEFORE and gap.strip() in ("", ":", ",")) or stroke
    out += ["lexicon"] * known + ["clear"] * (known and not every) + ["every"] * every + ["before"] * before + ["after"] * (r1 in AFTER) + ["article"] * (l1 in ARTICLES) + ["place"] * (l1 in PLACE)
    out += ["inner"] * (title and not first) + ["first"] * (title and first) + ["lower"] * text[s.start].islower() + ["upper"] * upper + ["surname"] * bool(SURNAME.match(low[i])) + ["genitive"] * genitive
    out += ["introduced"] * (l1 in INTRODUCED or stroke) + ["alone"] * (first and (r1 == "$" or "\n" in text[s.end : s.end + 2])) + ["mvh"] * ("\n" in gap and l1 in ("mvh", "hälsningar", "hälsning"))
    if every:
        plain = r1 in PLAIN_AFTER and text[s.end : s.end + 1] == " "
        out += ["every+plain"] * plain + ["every+before"] * (before and l1 not in ARTICLES) + ["every+article"] * (l1 in ARTICLES) + ["every+lower"] * text[s.start].islower() + ["every+genitive"] * genitive + ["every+first"] * (first and not plain) + ["every+inner"] * (title and not first) + ["every+inner+before"] * (title and not first and before) + ["every+place"] * (l1 in PLACE)
        out += ["every+var"] * (l1 in ("var", "är") and r1 == "som")
    elif not known:
        out += ["unknown+introduced"] * (l1 in INTRODUCED or stroke) + ["unknown+surname"] * bool(SURNAME.match(low[i])) + ["unknown+lower"] * text[s.start].islower() + ["unknown+place"] * (l1 in PLACE)
    return out


#: Chain links by what stands between two nodes, for digits, house numbers, names, others and words before a street; then the skip links: same form, mailbox like a name.
GAPS, PAIRS = 5, 5
SAME, LIKE = GAPS * PAIRS, GAPS * PAIRS + 1
TYPES = LIKE + 1


def chain_type(text: str, a: Node, b: Node) -> int:
    gap = text[a.end : b.start]
    bare = gap.strip(" ")
    form = 3 if "\n" in gap else 0 if not bare else 2 if bare == "," else 4 if bare[0] in ".!?" and gap[-1:] == " " else 1
    kinds = {a.kind, b.kind}
    pair = 0 if kinds <= {"num", "digit"} else 4 if b.kind in ("street", "direction") else 1 if a.kind == "street" or (a.kind in ("num", "nr") and b.kind in ("letter", "num")) else 2 if kinds <= {"name", "cap", "letter"} else 3
    return form * PAIRS + pair


def links(found: list[Node], texts) -> list[tuple[int, int, int]]:
    """(i, j, type) of chain links between neighbouring tokens, and of skip links to the next node of the same form and from names to the first mailbox that begins with them."""
    out, last, boxes = [], {}, {}
    for i, s in enumerate(found):
        if i and found[i - 1].doc == s.doc and s.at - found[i - 1].at == 1:
            out.append((i - 1, i, chain_type(texts[s.doc], found[i - 1], s)))
        if s.kind in ("name", "cap", "num") and len(s.key) > 2:
            k = (s.doc, s.kind == "num", s.key)
            if k in last:
                out.append((last[k], i, SAME))
            last[k] = i
        elif s.kind == "mail":
            start = LETTERS.match(s.key)
            for n in range(3, len(start[0]) + 1 if start else 0):
                boxes.setdefault((s.doc, s.key[:n]), i)
    if boxes:
        out += [(i, boxes[s.doc, s.key], LIKE) for i, s in enumerate(found) if s.kind in ("name", "cap") and (s.doc, s.key) in boxes]
    return out


class Crf:
    """Unary weights per feature and label, pair potentials per type of link and two labels."""

    def __init__(self, index: dict[str, int], unary: np.ndarray, pair: np.ndarray):
        self.index, self.unary, self.pair = index, unary, pair

    def scores(self, found: list[Node]) -> np.ndarray:
        sizes = [len(s.features) for s in found]
        at = np.fromiter((self.index.get(f, -1) for s in found for f in s.features), np.int64, sum(sizes))
        rows = np.where((at >= 0)[:, None], self.unary[at], 0.0)
        return np.add.reduceat(rows, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) if len(found) else np.zeros((0, len(LABELS)))

    def decode(self, found: list[Node], texts, rounds: int = 12) -> np.ndarray:
        """Labels by loopy sum-product message passing over chain and skip links, all documents of the batch at once."""
        beliefs = self.scores(found)
        net = Links(links(found, texts))
        if net.n:
            messages = np.zeros((2 * net.n, len(LABELS)))
            for _ in range(rounds):
                messages = net.pass_on(beliefs, self.pair, messages)
            beliefs = net.gather(beliefs, messages)
        return beliefs.argmax(1)


class Links:
    """Links of a batch in both directions; messages[k] goes from src[k] to dst[k]."""

    def __init__(self, edges: list[tuple[int, int, int]]):
        e = np.array(edges, np.int64).reshape(-1, 3)
        self.n, self.type = len(e), e[:, 2]
        self.src, self.dst = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
        self.back = np.concatenate([np.arange(self.n) + self.n, np.arange(self.n)])
        self.order = np.argsort(self.dst, kind="stable")
        self.heads, first = np.unique(self.dst[self.order], return_index=True)
        self.first = first

    def gather(self, u: np.ndarray, messages: np.ndarray) -> np.ndarray:
        total = u.copy()
        total[self.heads] += np.add.reduceat(messages[self.order], self.first, axis=0)
        return total

    def pass_on(self, u: np.ndarray, pair: np.ndarray, messages: np.ndarray, keep: float = 0.3) -> np.ndarray:
        """One round of damped messages."""
        x = self.gather(u, messages)[self.src] - messages[self.back]
        x = np.exp(x - x.max(1, keepdims=True))[:, None, :]
        w = np.exp(pair)
        new = np.log(np.concatenate([x[: self.n] @ w[self.type], x[self.n :] @ w.transpose(0, 2, 1)[self.type]])[:, 0] + 1e-30)
        return keep * messages + (1 - keep) * (new - new.max(1, keepdims=True))

    def joint(self, u: np.ndarray, pair: np.ndarray, messages: np.ndarray) -> np.ndarray:
        """The beliefs about both ends of each link."""
        total = self.gather(u, messages)
        x = (total[self.src] - messages[self.back])[: self.n, :, None] + (total[self.dst] - messages)[: self.n, None, :] + pair[self.type]
        x = np.exp(x - x.max((1, 2), keepdims=True))
        return x / x.sum((1, 2), keepdims=True)


def parse(line: str, doc: int) -> tuple[str, list[Node]]:
    """(text, nodes with their labels) of a marked document."""
    text, gold, at = "", [], 0
    for m in re.finditer(r"\[(email|phone|id_number|address|name) ((?:\[at\]|\[dot\]|[^\[\]])+)\]", line, re.I):
        text += line[at : m.start()]
        gold.append((len(text), len(text) + len(m[2]), LABELS.index(m[1].lower())))
        text += m[2]
        at = m.end()
    text += line[at:]
    found = nodes(text, doc)
    for s in found:
        s.label = next((k for a, b, k in gold if s.start < b and a < s.end), 0)
    return text, found


def train(lines: list[str] | None = None, steps: int = 160, rate: float = 0.3, decay: float = 5e-5) -> Crf:
    """Weights by likelihood, with the beliefs of the same message passing as expectations, from generated documents; deterministic, a fixed number of them."""
    texts, found = [], []
    for i, line in enumerate(documents(sorted(NAMES)) if lines is None else lines):
        text, own = parse(line, i)
        texts.append(text)
        found += own
    index = {f: i for i, f in enumerate(sorted({f for s in found for f in s.features}))}
    x = np.zeros((len(found), len(index)), np.float32)
    for i, s in enumerate(found):
        x[i, [index[f] for f in s.features]] = 1
    label = np.array([s.label for s in found])
    y, net = np.eye(len(LABELS), dtype=np.float32)[label], Links(links(found, texts))
    seen = np.zeros((TYPES, len(LABELS), len(LABELS)))
    np.add.at(seen, (net.type, label[net.src[: net.n]], label[net.dst[: net.n]]), 1)
    unary, pair = np.zeros((len(index), len(LABELS)), np.float32), np.zeros_like(seen)
    gu, gp, messages = np.zeros_like(unary), np.zeros_like(pair), np.zeros((2 * net.n, len(LABELS)))
    by_type = np.zeros((TYPES, net.n), np.float32)
    by_type[net.type, np.arange(net.n)] = 1
    for _ in range(steps):
        u = (x @ unary).astype(np.float64)
        for _ in range(3):  # messages go on from the step before
            messages = net.pass_on(u, pair, messages, 0.0)
        beliefs = net.gather(u, messages)
        p = np.exp(beliefs - beliefs.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        du = x.T @ (y - p).astype(np.float32) - decay * len(found) * unary
        dp = seen - (by_type @ net.joint(u, pair, messages).reshape(net.n, -1)).reshape(seen.shape) - decay * len(found) * pair
        gu, gp = gu + du**2, gp + dp**2
        unary += rate * du / np.sqrt(gu + 1.0)
        pair += rate * dp / np.sqrt(gp + 1.0)
    return Crf(index, unary, pair)


@lru_cache(1)
def trained() -> Crf:
    """The model of the generated documents, fitted once a session."""
    return train()


def groups(found: list[Node], labels: np.ndarray, texts) -> Iterator[tuple[str, list[Node]]]:
    """Runs of linked neighbours with one label; phone and identity numbers count as one kind."""
    run: list[Node] = []
    kind = 0
    for s, k in zip(found, labels):
        k = 2 if k == 3 else int(k)
        joined = run and k == kind and run[-1].doc == s.doc and s.at - run[-1].at == 1 and "\n" not in texts[s.doc][run[-1].end : s.start]
        if joined and k != 1 and not (k == 5 and texts[s.doc][run[-1].end : s.start].strip() not in ("", ",", ".", "-")):
            run.append(s)
            continue
        if run and kind:
            yield LABELS[kind], run
        run, kind = [s], k
    if run and kind:
        yield LABELS[kind], run


def checked(kind: str, run: list[Node], text: str, labels: dict[int, int]) -> tuple[int, int, str] | None:
    """The exact check after the model: (start, end, kind) of a run of nodes with that label, or nothing."""
    start, end = run[0].start, run[-1].end
    if kind == "email":
        return (start, end, kind) if run[0].kind == "mail" else None
    if kind == "phone":
        if run[0].kind == "digit":
            return (start, end, kind) if len(run) >= 7 else None
        while start and text[start - 1] in "+(":
            start -= 1
        span = text[start:end]
        number, phone = is_id(span), is_phone(span)
        if number and phone:
            number = sum(labels[id(s)] == 3 for s in run) * 2 >= len(run)
        return (start, end, "id_number" if number else "phone") if number or phone else None
    if kind == "address":
        streets = [k for k, s in enumerate(run) if s.kind == "street"]
        house = [s for s in run[streets[0] + 1 :] if s.kind == "num" and len(s.key) <= 3] if streets else []
        return (start, end, kind) if house else None
    given = any(s.kind == "name" or s.kind == "cap" and not SURNAME.match(text[s.start : s.end].lower()) for s in run)
    return (start, end, kind) if given else None


def find(texts: list[str], model: Crf) -> list[list[tuple[int, int, str]]]:
    """Per text the (start, end, kind) of its personal information, in order."""
    found = [s for d, t in enumerate(texts) if t for s in nodes(t, d)]
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    labels = model.decode(found, texts)
    named = {id(s): int(k) for s, k in zip(found, labels)}
    for kind, run in groups(found, labels, texts):
        hit = checked(kind, run, texts[run[0].doc], named)
        if hit:
            out[run[0].doc].append(hit)
    return out


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for start, end, kind in found:
        if start >= at:
            parts += [text[at:start], PLACES[kind]]
            at = end
    return "".join(parts) + text[at:]


def redact_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, redacted, kinds) of every row: the text with typed placeholders, and the distinct kinds found, sorted.

    A map-only plan over whole texts. A null text stays null with no kinds; an empty one stays empty; repeated rows repeat; an empty table gives an
    empty result; other columns are not read.
    """
    src = clash_free(df, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(trained())  # fixed size: fitted on a fixed number of generated documents

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [t if isinstance(t, str) else None for t in f[text_col]]
            got = find([t or "" for t in texts], shared.value)
            yield pd.DataFrame({
                id_col: f[id_col], "redacted": [None if t is None else redact(t, g) for t, g in zip(texts, got)], "kinds": [sorted({k for _, _, k in g}) for g in got],
            })

    return src.mapInPandas(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, redacted string, kinds array<string>")


def personal_kinds(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind): each row and each kind of personal information in its text, once."""
    return redact_texts(df, id_col, text_col).select(id_col, F.explode("kinds").alias("kind"))
