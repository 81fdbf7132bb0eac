"""Shared phrases and features of adjacent turns in DuckDB's SQL, as common table expressions over pairs(id, text_a, text_b)."""

from __future__ import annotations

from ..functions import lexicon as L

_STOP = "".join(sorted(L.STOP_CHARS))
_EDGE = L.PHRASE_EDGE.replace("'", "''").replace("\t", "' || chr(9) || '").replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '")
_WORDS = "[" + ", ".join(f"'{w}'" for w in sorted(L.STOPWORDS)) + "]"


def _front(x: str) -> str:
    """Without the stop characters in front, of which two characters stay."""
    return f"substr({x}, 1 + greatest(least(length({x}) - length(ltrim({x}, '{_STOP}')), length({x}) - 2), 0))"


def _back(x: str) -> str:
    return f"substr({x}, 1, length({x}) - greatest(least(length({x}) - length(rtrim({x}, '{_STOP}')), length({x}) - 2), 0))"


def _list(terms) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


def _in(terms, text: str) -> str:
    return f"list_filter({_list(terms)}, lambda m: strpos({text}, m) > 0)"



def phrases_sql() -> str:
    """said: the distinct pairs of texts, with `shared`, their shared phrases."""
    solid = lambda x: f"length({x}) >= 2 AND NOT list_contains({_WORDS}, {x}) AND length(translate({x}, '{_STOP}', '')) > 0"
    tokens = lambda t: f"""list_concat(list_filter(regexp_extract_all({t}, '{L.CHUNK}'), lambda x: NOT list_contains({_WORDS}, x)),
      list_filter(list_transform(range(1, length(regexp_replace({t}, '[^一-鿿]+', '', 'g'))), lambda i: substr(regexp_replace({t}, '[^一-鿿]+', '', 'g'), CAST(i AS BIGINT), 2)), lambda x: NOT regexp_matches(x, '[{_STOP}]') AND NOT list_contains({_WORDS}, x)))"""  # noqa: E731
    first = lambda xs, n: f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)[1:{n}]"
    return f"""said0 AS (SELECT DISTINCT text_a, text_b FROM pairs),
norm AS (SELECT *, trim(regexp_replace(coalesce(text_a, ''), '\\s+', ' ', 'g')) AS a, trim(regexp_replace(coalesce(text_b, ''), '\\s+', ' ', 'g')) AS b FROM said0),
ends AS (SELECT text_a, text_b, a, b, i, j FROM (SELECT *, unnest(range(1, length(a) + 1)) AS i FROM norm), LATERAL (SELECT unnest(range(1, length(b) + 1)) AS j) WHERE substr(a, i, 1) = substr(b, j, 1) AND substr(a, i, 1) <> ' '),
lens AS (SELECT text_a, text_b, a, i, j, max(n) AS n FROM (SELECT *, unnest(range(1, least(i, j) + 1)) AS n FROM ends) WHERE substr(a, i - n + 1, n) = substr(b, j - n + 1, n) AND strpos(substr(a, i - n + 1, n), ' ') = 0 GROUP BY ALL),
cut0 AS (SELECT text_a, text_b, i, j, trim(substr(a, i - n + 1, n), '{_EDGE}') AS p FROM lens WHERE n >= 2),
cut1 AS (SELECT text_a, text_b, i, j, {_front('p')} AS p FROM cut0),
cut2 AS (SELECT text_a, text_b, i, j, {_back('p')} AS p FROM cut1),
cut3 AS (SELECT text_a, text_b, i, j, p, trim(p, '{_EDGE}') AS q FROM cut2),
fine AS (SELECT text_a, text_b, p, min((i, j)) AS place FROM (SELECT *, {_back(_front('q'))} AS t FROM cut3) WHERE length(p) >= 2 AND {solid('t')} GROUP BY ALL),
best AS (SELECT text_a, text_b, list(p ORDER BY place)[1:5] AS common FROM (SELECT *, max(length(p)) OVER (PARTITION BY text_a, text_b) AS most FROM fine) WHERE length(p) = most GROUP BY ALL),
toks AS (SELECT n.text_a, n.text_b, coalesce(common, []) AS common, {tokens('n.a')} AS ta, {tokens('n.b')} AS tb FROM norm n LEFT JOIN best USING (text_a, text_b)),
sides AS (SELECT text_a, text_b, common, {first('ta', 24)} AS ta, {first('tb', 24)} AS tb FROM toks),
terms AS (SELECT text_a, text_b, list_transform(list_concat(common, list_filter(ta, lambda x: list_contains(tb, x))), lambda x: trim(x, '{_EDGE}')) AS xs FROM sides),
trimmed AS (SELECT text_a, text_b, list_transform(list_transform(xs, lambda x: {_front('x')}), lambda x: {_back('x')}) AS xs FROM terms),
said AS (SELECT text_a, text_b, list_reduce(xs, lambda kept, x: CASE WHEN NOT ({solid(_back(_front(f"trim(x[1], '{_EDGE}')")))}) OR len(list_filter(kept, lambda k: strpos(k, x[1]) > 0)) > 0 OR len(kept) >= 24 THEN kept
  ELSE list_append(list_filter(kept, lambda k: strpos(x[1], k) = 0), x[1]) END) AS shared FROM (SELECT text_a, text_b, list_prepend(CAST([] AS VARCHAR[]), list_transform(xs, lambda x: [x])) AS xs FROM trimmed))"""


def features_sql() -> str:
    """feats: id of each pair, its terms, markers and flags."""
    frames = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(a, '{p}') AND regexp_matches(b, '{p}') THEN '{label}' END" for label, p in L.FRAMES) + ", CASE WHEN strpos(a, '为什么') > 0 AND strpos(b, '因为') > 0 THEN '为什么...因为' END], lambda x: x IS NOT NULL)"
    kinds = ("lexical_echo", "pattern_reuse", "qa_response", "contrast_response", "repair_revision")
    every = "list_concat(list_concat(list_concat(list_concat(lexical_echo, pattern_reuse), qa_response), contrast_response), repair_revision)"
    flags = ", ".join(f"CAST(len({k}) > 0 AS INTEGER) AS {L.FLAGS[k]}" for k in kinds)
    return f"""{phrases_sql()},
w0 AS (SELECT p.id, coalesce(p.text_a, '') AS a, coalesce(p.text_b, '') AS b, s.shared FROM pairs p JOIN said s ON s.text_a = p.text_a AND s.text_b = p.text_b),
w1 AS (SELECT *, {frames} AS frames, {_in(L.QUESTION_MARKERS, 'a')} AS asked, {_in(L.CONTRAST_MARKERS, 'b')} AS contrast, {_in(L.REVISION_MARKERS, 'b')} AS revised, {_in(L.RESPONSE_MARKERS, 'b')} AS responded FROM w0),
w2 AS (SELECT *, shared[1:5] AS lexical_echo, CASE WHEN len(frames) > 0 THEN frames[1:4] WHEN len(shared) > 1 THEN shared[1:4] ELSE [] END AS pattern_reuse,
  CASE WHEN len(asked) > 0 AND (len(responded) > 0 OR length(b) >= 8) THEN asked[1:3] ELSE [] END AS qa_response, contrast[1:4] AS contrast_response,
  CASE WHEN len(shared) > 0 AND len(revised) > 0 THEN list_concat(shared[1:3], revised[1:3]) ELSE [] END AS repair_revision FROM w1),
w3 AS (SELECT *, {every} AS every FROM w2),
feats AS (SELECT id, shared[1:8] AS shared_terms, list_filter(every, lambda x, i: list_position(every, x) = i)[1:12] AS markers, {flags} FROM w3)"""
