"""SQL counterparts that need more than a line: normalisers without look-around, packed effects, display columns, JSON and sessions."""

from __future__ import annotations

from korpusverk.functions import texts as T
from korpusverk.operators import pairing as P

#: How a word may begin after white space, at the start or after a mark that is kept (\\2), and how it must not go on.
_EDGE = r"(\s+|^|([^\p{L}\p{N}_\s]))"
_BLANK = r"[\t\n\x0b\f\r ]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replaced(c: str, pattern: str, keep: str = "", flags: str = "g") -> str:
    return f"regexp_replace({c}, {quoted(pattern)}, {quoted(keep)}, '{flags}')"


def tidy(c: str) -> str:
    return replaced(replaced(replaced(c, r"\n{3,}", "\n\n"), rf"^{_BLANK}+"), rf"{_BLANK}+$")


def unescape(c: str) -> str:
    for pattern, keep in T.ENTITIES:
        c = replaced(c, pattern, keep)
    return c


def informal(c: str, drop_quoted: bool = False) -> str:
    """The informal normaliser."""
    c = unescape(c)
    if drop_quoted:
        c = replaced(c, r"(?m)^[ \t]*>[ \t]?[^\s\d=][^\n\r]*$")
    else:
        c = replaced(replaced(c, r"(?m)^[ \t]*>[ \t]?([^\s\d=])", r"\1"), r"(\s)>([^\s\d=])", r"\1\2")
    return tidy(replaced(c, SIGNOFF, r"\2"))


SIGNOFF = rf"(?is){_EDGE}m\.?v\.?h(?:[\s,.:/-]+(?:[\p{{L}}\p{{N}}_./-]+[ \t]?){{0,5}})?$"

#: The markdown patterns with their content in one group.
MARKDOWN = (
    (r"(?m)^[ \t]*#{1,6}[ \t]+", ""), (r"(?m)^[ \t]*(?:-{3,}|\*{3,}|_{3,})[ \t]*$", ""), (r"(?s)\*\*([^\s]|[^\s].*?[^\s])\*\*", r"\1"), (r"(?s)__([^\s]|[^\s].*?[^\s])__", r"\1"),
    (r"(^|[^*])\*([^\s*]|[^\s*][^*\n]*?[^\s*])\*($|[^*])", r"\1\2\3"), (r"`([^\s`]|[^\s`][^`\n]*?[^\s`])`", r"\1"),
)


def formal(c: str) -> str:
    """The normaliser of machine abstracts."""
    for pattern, keep in MARKDOWN:
        c = replaced(c, pattern, keep)
        if keep.count("\\") == 3:
            c = replaced(c, pattern, keep)  # marks that share a neighbour
    c = replaced(c, rf"(?is){_EDGE}(?:nyckelord|nyckelbegrepp|nyckelfraser|keywords?|sökord)\s*[:：].*$", r"\2", "")
    return tidy(replaced(c, r"(?i)^\s*(?:sammanfattning|sammandrag|abstrakt|abstract|syfte|inledning)\s*[:.]?\s+", "", ""))


def artefact(c: str) -> str:
    plain = unescape(c)
    entity = " OR ".join(f"regexp_matches({c}, {quoted(p)})" for p, _ in T.ENTITIES)
    hits = f"""concat_ws('+', CASE WHEN {entity} THEN 'html_entity' END, CASE WHEN regexp_matches({plain}, {quoted(r'(?m)^[ \t]*>[ \t]?[^\s\d=]')}) OR regexp_matches({plain}, {quoted(r'\s>[^\s\d=]')}) THEN 'quote_marker' END, CASE WHEN regexp_matches({plain}, {quoted(SIGNOFF)}) THEN 'signoff' END)"""
    return f"CASE WHEN {hits} <> '' THEN {hits} WHEN regexp_matches({c}, {quoted(r'\n{3,}')}) THEN 'blank_lines' ELSE 'whitespace_only' END"


def has_markdown(c: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, {quoted(p)})" for p, _ in MARKDOWN) + ")"


NORMALIZE_INFORMAL = f"""SELECT row_id, n AS text, {informal('human_comment', True)} AS without_quotes, {artefact('human_comment')} AS artefact, n <> human_comment AS changed, n <> trim(human_comment, ' ') AS changed_in_substance
 FROM (SELECT row_id, human_comment, {informal('human_comment')} AS n FROM {P.INFORMAL[1]} WHERE human_comment IS NOT NULL)"""


def normalize_formal(long_sql: str) -> str:
    return f"SELECT row_id, condition, {formal('llm')} AS text, {has_markdown('llm')} AS markdown FROM ({long_sql}) WHERE register = 'formal' AND llm IS NOT NULL"


def audit(long_sql: str, non_empty: str, refusal: str) -> str:
    """refusal: the reason's CASE over head."""
    return f"""SELECT register, condition, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (NOT coalesce({non_empty.format('llm')}, false)) AS BIGINT) AS empty, CAST(count(*) FILTER ({refusal} IS NOT NULL) AS BIGINT) AS refusals,
 CAST(count(*) FILTER ({has_markdown('llm')}) AS BIGINT) AS with_markdown FROM (SELECT *, substr(llm, 1, 300) AS head FROM ({long_sql})) GROUP BY register, condition"""


_STARS = "CASE WHEN fdr < 0.001 THEN '***' WHEN fdr < 0.01 THEN '**' WHEN fdr < 0.05 THEN '*' ELSE '' END"
_BAND = "CASE WHEN abs({0}) >= 0.8 THEN 'large' WHEN abs({0}) >= 0.5 THEN 'medium' WHEN abs({0}) >= 0.2 THEN 'small' ELSE 'negligible' END"


def effect_summary(tests: str) -> str:
    """tests: the CTEs up to e(register, condition, feature, dz, fdr, mh, ml)."""
    return f"""WITH {tests}, t AS (SELECT *, condition || ' ' || format('{{:+.2f}}', round(dz, 2) + 0.0) || {_STARS} AS shown, CASE WHEN ml > mh THEN 'llm > human' WHEN ml < mh THEN 'llm < human' ELSE 'equal' END AS direction FROM e)
 SELECT register, feature, string_agg(shown, '; ' ORDER BY shown) AS effects, CASE WHEN min(direction) = max(direction) THEN min(direction) ELSE 'mixed' END AS direction, {_BAND.format('max(abs(dz))')} AS band, round(max(abs(dz)), 6) AS max_effect, round(median(abs(dz)), 6) AS median_effect,
 CAST(count(*) FILTER (fdr < 0.05) AS BIGINT) AS n_significant, CAST(count(*) AS BIGINT) AS n_tests FROM t GROUP BY register, feature"""


def _colour(value: str, low: float, high: float, hue: float = 250.0) -> str:
    """The hexadecimal colour of a value, step by step as in the published conversion from OKLCH to sRGB."""
    t = f"least(greatest(({value} - {low}) / ({high} - {low}), 0.0), 1.0)"
    light, chroma = f"(0.97 - {t} * 0.42)", f"(0.02 + {t} * 0.12)"
    a, b = f"({chroma} * cos(radians({hue})))", f"({chroma} * sin(radians({hue})))"
    cone = [f"pow({light} + {x} * {a} + ({y}) * {b}, 3.0)" for x, y in ((0.3963377774, 0.2158037573), (-0.1055613458, -0.0638541728), (-0.0894841775, -1.2914855480))]
    parts = []
    for row in ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010)):
        linear = "least(greatest(" + " + ".join(f"{c} * ({k})" for c, k in zip(cone, row)) + ", 0.0), 1.0)"
        parts.append(f"printf('%02X', CAST(round((CASE WHEN {linear} <= 0.0031308 THEN {linear} * 12.92 ELSE pow({linear}, {1 / 2.4!r}) * 1.055 - 0.055 END) * 255) AS BIGINT))")
    return "'#' || " + " || ".join(parts)


def top_effects(tests: str) -> str:
    p = "CASE WHEN fdr <= 0.0001 THEN '<0.001' WHEN fdr < 1e-3 THEN printf('%.1e', fdr) ELSE printf('%.3f', fdr) END"
    return f"""WITH {tests}, shown AS (SELECT register, condition, feature, round(dz, 6) AS cohens_dz, round(fdr, 6) AS fdr FROM e WHERE fdr < 0.05), placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY register, condition ORDER BY abs(cohens_dz) DESC, feature) AS INT) AS place FROM shown)
 SELECT register, condition, place, feature, cohens_dz, {_BAND.format('cohens_dz')} AS band, {p} AS p, {_colour('abs(cohens_dz)', 0.0, 2.0)} AS colour FROM placed WHERE place <= 3"""


def normalisation_delta(long_sql: str, non_empty: str, alpha: str, tests: str) -> str:
    """tests: the test CTEs over x(condition, version, human, llm)."""
    n = lambda c: f"CAST(len({alpha.format(c)}) AS DOUBLE)"
    return f"""WITH raw AS (SELECT condition, human, llm FROM ({long_sql}) WHERE register = 'informal' AND {non_empty.format('human')} AND {non_empty.format('llm')}),
 x AS (SELECT condition, 'pre' AS version, {n('human')} AS human, {n('llm')} AS llm FROM raw UNION ALL SELECT condition, 'post', {n(informal('human'))}, {n(informal('llm'))} FROM raw), {tests},
 sides AS (SELECT condition, max(dz) FILTER (version = 'pre') AS a, max(dz) FILTER (version = 'post') AS b, max(mh) FILTER (version = 'pre') AS ma, max(mh) FILTER (version = 'post') AS mb, max(n_pairs) FILTER (version = 'pre') AS na, max(n_pairs) FILTER (version = 'post') AS nb FROM e GROUP BY condition)
 SELECT condition, round(a, 6) AS dz_pre, round(b, 6) AS dz_post, round(b - a, 6) AS dz_change, round(100 * (mb - ma) / nullif(ma, 0.0), 6) AS human_change_pct, na AS n_pre, nb AS n_post, (abs(b - a) >= 0.01 OR abs(100 * (mb - ma) / nullif(ma, 0.0)) >= 0.5) AS moved FROM sides"""


def json_rows(table: str, key: str, columns: tuple[str, ...]) -> str:
    parts = "".join(f" || CASE WHEN {c} IS NULL THEN '' ELSE ',\"{c}\":' || CAST(to_json({c}) AS VARCHAR) END" for c in columns)
    return f"SELECT '{{\"{key}\":' || {key}{parts} || '}}' AS value FROM {table}"


SESSIONS = """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT ON (event_id) user_id, ts, event_id FROM events ORDER BY event_id, ts) WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT min(ts) AS start, user_id, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""
CSV_LINES = """WITH r AS (SELECT 'f' || (row_id % 64) AS path, CAST(row_id AS VARCHAR) || ',"' || human_comment || '"' AS raw, CAST(row_id AS VARCHAR) || ',"' || replace(replace(regexp_replace(human_comment, '\\r\\n|\\r|\\n', ' ', 'g'), '""', '"'), '"', '""') || '"' AS line
 FROM consolidated_informal_comments_adversarial WHERE human_comment IS NOT NULL) SELECT path, CAST(0 AS BIGINT) AS n, 'row_id,human_comment' AS line FROM r GROUP BY path UNION ALL SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY raw) AS BIGINT), line FROM r"""
