"""Text functions as Column macros: tokens, normalisers, artefacts, refusals, dates, keys and encoded map cells. All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from korpusverk.functions.lexicons import MONTHS

# --- tokens -------------------------------------------------------------------------------------------------------------------


def alpha_tokens(text: Column) -> Column:
    """Lower-cased letter runs; [] for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1)), F.array().cast("array<string>"))


def surface_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), F.lit(1)), F.array().cast("array<string>"))


def token_count(text: Column) -> Column:
    """Words, numbers and single marks."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]")), F.lit(0))


def sentences(text: Column) -> Column:
    """Parts after a full stop, question or exclamation mark and white space; [] for null and blank."""
    return F.filter(F.coalesce(F.split(F.trim(text), r"(?<=[.!?])\s+"), F.array().cast("array<string>")), lambda s: s != "")


def literal_count(text: Column, mark: str) -> Column:
    """Non-overlapping occurrences of mark."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / F.lit(len(mark))).cast("bigint")


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    """a / b * scale, 0 where b is 0."""
    return F.when(b > 0, a * F.lit(float(scale)) / b).otherwise(F.lit(0.0))


def non_empty(text: Column) -> Column:
    """Not null, blank (of any white space) or the text nan."""
    return text.isNotNull() & text.rlike(r"[^\s\p{Z}]") & ~text.rlike(r"^[\s\p{Z}]*[nN][aA][nN][\s\p{Z}]*$")


def word_count(text: Column) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.greatest(F.size(F.split(t, " ")), F.lit(1)).cast("bigint")


def syllables(text: Column) -> Column:
    """Vowel groups."""
    return F.regexp_count(F.regexp_replace(F.lower(text), r"[^a-zåäö]", " "), F.lit("[aeiouyåäö]+")).cast("bigint")


# --- normalisers --------------------------------------------------------------------------------------------------------------

#: Patterns of markdown, in the order in which they are taken out, with what stays.
MARKDOWN = (
    (r"(?m)^[ \t]*#{1,6}[ \t]+", ""),
    (r"(?m)^[ \t]*(?:-{3,}|\*{3,}|_{3,})[ \t]*$", ""),
    (r"(?s)\*\*(?=\S)(.+?)(?<=\S)\*\*", "$1"),
    (r"(?s)__(?=\S)(.+?)(?<=\S)__", "$1"),
    (r"(?<!\*)\*(?=\S)([^*\n]+?)(?<=\S)\*(?!\*)", "$1"),
    (r"`(?=\S)([^`\n]+?)(?<=\S)`", "$1"),
)
#: Footer, heading, entities, quote markers and sign-off.
FOOTER = r"(?isU)\s*\b(?:nyckelord|nyckelbegrepp|nyckelfraser|keywords?|sökord)\b\s*[:：].*\z"
HEADING = r"(?iu)^\s*(?:sammanfattning|sammandrag|abstrakt|abstract|syfte|inledning)\b\s*[:.]?\s+"
ENTITIES = (("&gt;", ">"), ("&lt;", "<"), ("&quot;", '"'), ("&#0?39;|&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
QUOTES = (r"(?m)^[ \t]*>[ \t]?(?=[^\s\d=])", r"(?<=\s)>(?=[^\s\d=])")
QUOTED_LINE = r"(?m)^[ \t]*>[ \t]?(?=[^\s\d=]).*$"
SIGNOFF = r"(?isU)\s*\bm\.?v\.?h\b[\s,.:/-]*(?:[\w.åäöÅÄÖ/-]+[ \t]?){0,5}\z"


def strip_markdown(text: Column) -> Column:
    for pattern, keep in MARKDOWN:
        text = F.regexp_replace(text, pattern, keep)
    return text


def markdown_count(text: Column) -> Column:
    total = F.lit(0)
    for pattern, _ in MARKDOWN:
        total = total + F.regexp_count(text, F.lit(pattern))
    return total.cast("bigint")


def tidy(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+", ""), r"\s+\z", "")


def normalize_formal(text: Column, human: Column | bool = False) -> Column:
    """Markdown, keyword footer and leading heading taken out of machine texts; human texts stay as they are."""
    done = tidy(F.regexp_replace(F.regexp_replace(strip_markdown(text), FOOTER, ""), HEADING, ""))
    return F.when(human if isinstance(human, Column) else F.lit(human), text).otherwise(done)


def unescape(text: Column) -> Column:
    for pattern, keep in ENTITIES:
        text = F.regexp_replace(text, pattern, keep)
    return text


def normalize_informal(text: Column, drop_quoted: bool = False) -> Column:
    """Entities, quote markers (or, with drop_quoted, quoted lines) and sign-off taken out of either side."""
    text = unescape(text)
    for pattern in (QUOTED_LINE,) if drop_quoted else QUOTES:
        text = F.regexp_replace(text, pattern, "")
    return tidy(F.regexp_replace(text, SIGNOFF, ""))


def artefacts(text: Column) -> Column:
    """html_entity, quote_marker and signoff joined by +; else blank_lines; else whitespace_only."""
    plain = unescape(text)
    entity = F.lit(False)
    for pattern, _ in ENTITIES:
        entity = entity | text.rlike(pattern)
    hits = F.concat_ws("+", F.when(entity, "html_entity"), F.when(plain.rlike(QUOTES[0]) | plain.rlike(QUOTES[1]), "quote_marker"), F.when(plain.rlike(SIGNOFF), "signoff"))
    return F.when(hits != "", hits).when(text.rlike(r"\n{3,}"), "blank_lines").otherwise("whitespace_only")


#: How a refusal opens, with the reason that is reported.
TASK = r"(?:hjälpa|bistå|assistera|skriva|generera|producera|skapa|framställa|uppfylla|tillmötesgå|utföra|göra\s+det|ställa\s+upp)"
REFUSALS = (
    (rf"(?iU)\bjag\s+kan\s+(?:dessvärre\s+|tyvärr\s+)?inte\s+(?:\w+\s+){{0,3}}{TASK}\b", "sv: 'jag kan inte <task verb>'"),
    (rf"(?iU)\bkan\s+jag\s+inte\s+(?:\w+\s+){{0,3}}{TASK}\b", "sv: 'kan jag inte <task verb>'"),
    (rf"(?iU)\bjag\s+(?:får|kommer)\s+inte\s+(?:att\s+)?(?:\w+\s+){{0,2}}{TASK}\b", "sv: 'jag får/kommer inte <task verb>'"),
    (r"(?iU)\bI\s+(?:can'?t|cannot|won'?t|am\s+not\s+able\s+to)\s+(?:\w+\s+){0,3}(?:help|assist|write|generate|produce|create|comply|do\s+that)\b", "en: 'I can't <task verb>'"),
    (r"(?iU)\bkringgå\b[^.\n]{0,40}\b(?:detekt|AI|granskning)", "sv: 'kringgå ... detektering'"),
    (r"(?iU)\bAI[- ]?detekt\w*", "meta: mentions AI detection"),
    (r"(?iU)\bas an AI\b|\bsom en AI\b|\bAI-(?:modell|assistent)\b", "meta: refers to itself as an AI"),
)


def refusal_reason(text: Column, head: int = 300) -> Column:
    """The first pattern that the opening of the text matches; null if none."""
    opening = F.substring(text, 1, head)
    return F.coalesce(*[F.when(opening.rlike(p), why) for p, why in REFUSALS])


#: Stems by which a judge's reasoning is coded.
CUES = {
    "template": r"mallarta|schablon|formelakti|schematis|stereotyp|standardiserad|välstrukturer|välordnad|välbalanserad|struktur|uppräkning|symmetri|jämn|balanserad|förutsägbar|uppbyggnad|mönster|meningsbyggnad|parallellism|tredelad|följer ett",
    "specifics": r"konkret|specifik|detalj|siffr|namngiv|egennamn|referens|exempel|precis[ea]? uppgift|faktiska",
    "impersonal": r"opersonlig|neutral|distanserad|saklig|objektiv|generisk|allmänt hållen|allmänt hållet|allmänna ordalag|intetsägande|torr|svepande|vag|hedg|(?:saknar|avsaknad av|utan|inga) (?:\w+ )?person",
    "emotion": r"känsla|känslor|känslo(?:mässig|laddad|uttryck)|emotion|subjektiv|åsikt|tycker|engagemang|engagerad|humor|humoristisk|ironi|sarkas|frustration|entusias|irritation|upprörd|indignation|person(?:lig|liga|ligt) (?:åsikt|erfarenhet|upplevelse|anekdot|ton|prägel|röst)",
    "colloquial": r"vardaglig|talspråk|slang|informell|informellt|informella|dialekt|förkortning|emoji|smilis|svordom|utrop|muntlig|ledig ton|jargong",
    "lexical": r"upprepning|upprepa|upprepad|repetitiv|repetition|enformig|variation|varierad|varierande|varierat|samma ord|ordval|ordförråd|synonym",
    "polish": r"stavfel|skrivfel|felfri|inga fel|utan fel|polerad|polerat|slipad|perfekt|grammatiskt korrekt|språkligt korrekt|korrekt interpunktion|skiljetecken|korrekturläst|oklanderlig|felstavning",
}
#: Content that excludes a text, links, sensitive topics and pictographs.
BLOCKED = r"porr|porno|pornogr|\bporn\b|\bxxx\b|knull|\bfitt(a|an|or|orna)\b|\bkuk(ar|en)?\b|snopp|runk|onan|samlag|orgasm|avsug|\bdildo|vibrator|\bsex\b|sexuell|sexst|sexchatt|sexfilm|sexvideo|analsex|\banala\b|trekant|gangbang|blowjob|\bhora\b|\bhoror\b|bordell|prostitu|eskort|\bescort|nakenbild|\bnaken\b|brostvart|stånd|erektion|\bslampa\b|\bhorunge\b"
LINK = r"https?://|www\.|\]\(|\[deleted\]|\[removed\]"
SENSITIVE = r"v[åa]ldt|invandr|flykting|migration|\basyl|utvisn|\bmord|m[öo]rda|nazi|rasis|fr[äa]mlingsfi|islam|muslim|\bjud(e|ar|isk)|terror|\bkrig|brottsl|kriminel|\bsd\b|sverigedemokrat|åkesson|abort|pedofil|övergrepp|misshandel|\bvåld\b|\brån\b|knark|droger|sj[äa]lvmord"
PICTOGRAPH = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]"


def matches(text: Column, pattern: str) -> Column:
    """Case-insensitive search; false for null."""
    return F.coalesce(text.rlike("(?iu)" + pattern), F.lit(False))


# --- dates, keys, markup ------------------------------------------------------------------------------------------------------


def parse_date(text: Column) -> Column:
    """YYYY-MM-DD anywhere, else day, Swedish month name and year; null for other texts and for impossible dates."""
    iso = F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.lit("yyyy-MM-dd")))
    rx = r"(?iu)(\d{1,2})\s+([a-zåäö]+)\s+(\d{4})"
    month = F.create_map(*[x for m, i in MONTHS.items() for x in (F.lit(m), F.lit(f"{i:02d}"))])[F.substring(F.lower(F.regexp_extract(text, rx, 2)), 1, 3)]
    named = F.concat_ws("-", F.regexp_extract(text, rx, 3), month, F.lpad(F.regexp_extract(text, rx, 1), 2, "0"))
    return F.coalesce(iso, F.to_date(F.try_to_timestamp(F.when(month.isNotNull(), named), F.lit("yyyy-MM-dd"))))


def document_key(label: Column, text: Column) -> Column:
    """Both with single blanks, joined by a triple pipe."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.concat_ws("|||", squeeze(F.coalesce(label, F.lit(""))), squeeze(F.coalesce(text, F.lit(""))))


def html_escape(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def prompt(base: Column, suffix: Column) -> Column:
    return F.concat_ws("\n\n", base, F.nullif(suffix, F.lit("")))


def fill(template: Column, **values: Column) -> Column:
    """The template with each {name} replaced by its value, '' for null; values are not searched for names again if they hold none."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template


def with_question(question: Column, body: Column) -> Column:
    return F.concat_ws("\n\n", F.nullif(F.trim(question), F.lit("")), F.nullif(F.trim(body), F.lit("")))


# --- encoded cells ------------------------------------------------------------------------------------------------------------


def encode_map(counts: Column) -> Column:
    """TAG:n | TAG:n, sorted by tag."""
    pairs = F.array_sort(F.map_entries(counts))
    return F.array_join(F.transform(pairs, lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), " | ")


def decode_map(cell: Column, last: bool = True) -> Column:
    """MAP<STRING,BIGINT> of an encoded cell, split at the last colon (labels such as acl:relcl stay whole) or at the first."""
    rx = r"^(.*):\s*(\d+)$" if last else r"^([^:]*):\s*(\d+)$"
    parts = F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda p: p.rlike(rx))
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, rx, 1)).alias("key"), F.regexp_extract(p, rx, 2).cast("bigint").alias("value"))))


def token_cell_length(cell: Column) -> Column:
    """Non-empty parts of a comma-separated cell."""
    return F.size(F.filter(F.split(F.coalesce(cell, F.lit("")), ","), lambda t: F.trim(t) != "")).cast("bigint")


def map_difference(a: Column, b: Column) -> Column:
    """Per tag the share in a less the share in b, to 4 places; a missing tag counts 0."""
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x)
    return F.map_zip_with(a, b, lambda k, x, y: F.round(F.coalesce(x, F.lit(0)) / F.greatest(total(a), F.lit(1.0)) - F.coalesce(y, F.lit(0)) / F.greatest(total(b), F.lit(1.0)), 4))


def p_text(p: Column, floor: float) -> Column:
    return F.when(p <= floor, F.lit("<0.001")).when(p < 1e-3, F.format_string("%.1e", p)).otherwise(F.format_string("%.3f", p))


def heat_colour(value: Column, low: float = 0.5, high: float = 1.0, hue: float = 250.0) -> Column:
    """A hexadecimal sRGB colour for value, from light to dark in OKLCH at one hue."""
    t = F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    light, chroma = F.lit(0.97) - t * 0.42, F.lit(0.02) + t * 0.12
    a, b = chroma * F.cos(F.radians(F.lit(hue))), chroma * F.sin(F.radians(F.lit(hue)))
    cone = [F.pow(light + x * a + y * b, F.lit(3.0)) for x, y in ((0.3963377774, 0.2158037573), (-0.1055613458, -0.0638541728), (-0.0894841775, -1.2914855480))]
    rows = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))
    out = F.lit("#")
    for row in rows:
        linear = F.least(F.greatest(cone[0] * row[0] + cone[1] * row[1] + cone[2] * row[2], F.lit(0.0)), F.lit(1.0))
        srgb = F.when(linear <= 0.0031308, linear * 12.92).otherwise(F.pow(linear, F.lit(1 / 2.4)) * 1.055 - 0.055)
        out = F.concat(out, F.lpad(F.hex(F.round(srgb * 255).cast("bigint")), 2, "0"))
    return out
