"""DuckDB counterparts of the operators that SQL can express, built from the same settings."""

from __future__ import annotations

from .quality import BULK, CLASSES, Limits
from .substring import WINDOW

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def substring(window: int = WINDOW) -> str:
    return f"""WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + {window - 1}], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - {window - 2})) AS i FROM w)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS p FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
tok AS (SELECT doc_id, p, words[p] AS x FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM w)),
kept AS (SELECT t.doc_id, string_agg(t.x, ' ' ORDER BY t.p) AS k, count(*) AS n FROM tok t LEFT JOIN gone g ON g.doc_id = t.doc_id AND g.p = t.p WHERE g.p IS NULL GROUP BY t.doc_id)
SELECT w.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""


def quality(s: Limits = Limits()) -> str:
    gone = lambda text, pattern: f"length({text}) - length(regexp_replace({text}, '{pattern}', '', 'g'))"
    quoted = [p.replace("'", "''") for p in CLASSES]
    named = ", ".join(f"{gone('bare', p)} AS c{k}" for k, p in enumerate(quoted))
    n = len(CLASSES)
    rest = " - ".join(["length(bare)", *[f"c{k}" for k in range(n)]])
    part = lambda p, q: f"CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END"
    distance = lambda: f"sqrt(greatest(sum(({part('p', 'q')} + {part('q', 'p')}) / 2), 0))"
    return f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, {WORDS} AS words, regexp_replace(coalesce(text, ''), '{BULK}', '', 'g') AS bare FROM documents),
e AS (SELECT *, list_sum(list_transform(words, lambda x: length(x))) AS chars, {named} FROM d),
f AS (SELECT doc_id, lang, words, len(words) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars, length(bare) - length(translate(bare, '#*$%&|<>', '')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
  [length(bare), {', '.join(f'c{k}' for k in range(n))}, length(text) - coalesce(chars, 0), length(text) - length(bare) - (length(text) - coalesce(chars, 0)), {rest}][2:] AS classes FROM e),
g AS (SELECT doc_id, p, words[p:p + 2] AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS p FROM f)),
h AS (SELECT doc_id, s FROM g GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT g.doc_id, unnest([g.p, g.p + 1, g.p + 2]) AS p FROM g JOIN h ON h.doc_id = g.doc_id AND h.s = g.s) GROUP BY ALL),
c AS (SELECT doc_id, lang, unnest(classes) AS x, unnest(range(len(classes))) AS k FROM f),
cl AS (SELECT lang, k, sum(x) AS x FROM c GROUP BY ALL),
cd AS (SELECT doc_id, {distance()} AS class_distance FROM (SELECT c.doc_id, CAST(c.x AS DOUBLE) / sum(c.x) OVER (PARTITION BY c.doc_id) AS p, CAST(cl.x AS DOUBLE) / sum(cl.x) OVER (PARTITION BY c.doc_id) AS q FROM c JOIN cl ON cl.lang = c.lang AND cl.k = c.k) GROUP BY doc_id),
t AS (SELECT doc_id, lang, unnest(words) AS x FROM f),
u AS (SELECT lang, lower(x) AS x, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, lower(x)) AS k FROM t WHERE length(x) <= {s.common_length} AND regexp_full_match(x, '\\p{{L}}+') GROUP BY lang, lower(x) QUALIFY k <= {s.common_words}),
v AS (SELECT t.doc_id, t.lang, coalesce(u.k, 0) AS k, count(*) AS n FROM t LEFT JOIN u ON u.lang = t.lang AND u.x = lower(t.x) AND length(t.x) <= {s.common_length} GROUP BY ALL),
vl AS (SELECT lang, k, sum(n) AS n FROM v GROUP BY ALL),
y AS (SELECT f.doc_id, vl.k, coalesce(v.n, 0) AS n, vl.n AS m FROM f JOIN vl ON vl.lang = f.lang LEFT JOIN v ON v.doc_id = f.doc_id AND v.k = vl.k WHERE f.n_words > 0),
wd AS (SELECT doc_id, {distance()} AS word_distance FROM (SELECT doc_id, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY doc_id) AS p, CAST(m AS DOUBLE) / sum(m) OVER (PARTITION BY doc_id) AS q FROM y) GROUP BY doc_id),
z AS (SELECT f.doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, class_distance, word_distance,
  n_words < {s.min_words} OR 100 * coalesce(n_repeat_words, 0) > {s.max_repeat_percent} * n_words AS base_failed FROM f LEFT JOIN r ON r.doc_id = f.doc_id LEFT JOIN cd ON cd.doc_id = f.doc_id LEFT JOIN wd ON wd.doc_id = f.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(n_words >= {s.classes_from} AND class_distance > {s.class_distance} OR n_words >= {s.words_from} AND word_distance > {s.word_distance}, false) AS kept FROM z"""
