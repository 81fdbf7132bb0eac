"""Turns, pairs, resonance and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import is_valid_label, parse_speaker, resonance_tokens, terms_from_json
from ..operators import pairs as P
from ..operators.layout import by_conversation, conversation_counts
from ..operators.tables import ENTRIES_SQL, PHRASES, entries, pick, turns, turns_sql
from ..operators.terms import term_counts, with_terms_in
from .phrase_sql import features_sql, phrases_sql
from .registry import query

_PAIRS = """pairs AS (SELECT b.id, a.id AS turn_a_id, b.id AS turn_b_id, b.conversation_key, b.dataset_name, b.source, b.category, a.turn_index AS turn_index_a, b.turn_index AS turn_index_b,
  a.speaker_label AS speaker_a, b.speaker_label AS speaker_b, a.turn_text AS text_a, b.turn_text AS text_b FROM turns a JOIN turns b ON b.conversation_key = a.conversation_key AND b.turn_index = a.turn_index + 1)"""
_ASKED = " OR ".join(f"text_a LIKE '%{m}%'" for m in L.QUESTION_MARKERS)
_ANSWERED = " OR ".join(f"text_b LIKE '%{m}%'" for m in L.RESPONSE_MARKERS)


def _found(column: str, terms, most: int = 4) -> str:
    return f"list_filter({list(terms)}, lambda t: strpos({column}, t) > 0)[1:{most}]"


def _pairs(spark, sf_dir):
    return P.adjacent_pairs(turns(spark, sf_dir, True))


@query("turns_split")
def turns_split(spark, sf_dir):
    return P.split_entries(entries(spark, sf_dir))


_PAIR_OF = f"({list(PHRASES)})[CAST((id + 5) % {len(PHRASES)} AS INTEGER) + 1]"


@query("labelled_turns", f"WITH {ENTRIES_SQL}, l AS (SELECT id, title, ({list(PHRASES)})[CAST(id % {len(PHRASES)} AS INTEGER) + 1] AS a, {_PAIR_OF} AS b FROM entries) SELECT id * 1000000 + 1 AS id, id AS entry_id, 1 AS turn_index, '甲' AS speaker_label, a AS turn_text FROM l UNION ALL SELECT id * 1000000 + 2, id, 2, '记者', b FROM l")
def labelled_turns(spark, sf_dir):
    """Entries of two labelled lines, one in brackets, one after a blank line and with marks of half width."""
    line = lambda k: pick(PHRASES, F.col("id") + k)
    e = entries(spark, sf_dir).withColumn("content", F.concat(F.lit("【甲】： "), line(0), F.lit("\r\n\r\n  记者 : "), line(5)))
    return P.split_entries(e).select("id", "entry_id", "turn_index", "speaker_label", "turn_text")


@query("segment_turns", f"WITH {turns_sql()} SELECT id AS entry_id, 1 AS turn_index, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS turn_text, 'entry:' || id AS conversation_key FROM entries")
def segment_turns(spark, sf_dir):
    e = entries(spark, sf_dir).withColumn("current_segment", F.col("content")).withColumn("speaker", F.lit("甲"))
    return P.split_entries(e).select("entry_id", "turn_index", "turn_text", "conversation_key")


@query("speaker_parse", f"WITH {turns_sql(True)} SELECT id, speaker_label AS speaker, turn_text AS body FROM turns")
def speaker_parse(spark, sf_dir):
    t = turns(spark, sf_dir, True).withColumn("p", parse_speaker(F.concat(F.lit("【"), F.col("speaker_label"), F.lit("】： "), F.col("turn_text"))))
    return t.select("id", "p.speaker", F.col("p.text").alias("body"))


_LABELS = {"甲": True, "记者": True, "问题": True, "其中": False, "针对": False, "张三丰": True, "张三丰张三丰张三丰": False, "Anna-2": True, "2Anna": False, "": False, "说，话": False, "司 机": True, "部长先生等人们大家好大家好大家好大家好大家好大家好大家好大家好": True}


@query("speaker_labels", f"WITH {ENTRIES_SQL} SELECT id, ({list(_LABELS)})[CAST(id % {len(_LABELS)} AS INTEGER) + 1] AS label, ({[str(v).lower() for v in _LABELS.values()]})[CAST(id % {len(_LABELS)} AS INTEGER) + 1] = 'true' AS valid FROM entries")
def speaker_labels(spark, sf_dir):
    e = entries(spark, sf_dir).select("id", pick(tuple(_LABELS), F.col("id")).alias("label"))
    return e.select("id", "label", is_valid_label(F.col("label")).alias("valid"))


@query("adjacent_pairs", f"WITH {turns_sql(True)}, {_PAIRS} SELECT turn_a_id, turn_b_id, conversation_key, turn_index_a, turn_index_b, speaker_a, speaker_b, text_a, text_b FROM pairs")
def adjacent_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("turn_a_id", "turn_b_id", "conversation_key", "turn_index_a", "turn_index_b", "speaker_a", "speaker_b", "text_a", "text_b")


@query("function_patterns", f"WITH {turns_sql(True)}, {_PAIRS} SELECT id, " + "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text_a, '{p}') AND regexp_matches(text_b, '{p}') THEN '{label}' END" for label, p in L.FRAMES) + ", CASE WHEN strpos(text_a, '为什么') > 0 AND strpos(text_b, '因为') > 0 THEN '为什么...因为' END], lambda x: x IS NOT NULL)[1:4], '|') AS frames FROM pairs")
def function_patterns(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", F.array_join(P.frames(F.col("text_a"), F.col("text_b")), "|").alias("frames"))


@query("qa_response", f"WITH {turns_sql(True)}, {_PAIRS} SELECT id, text_a, text_b FROM pairs WHERE ({_ASKED}) AND ({_ANSWERED} OR length(text_b) >= 8)")
def qa_response(spark, sf_dir):
    return _pairs(spark, sf_dir).where(P.question_answer(F.col("text_a"), F.col("text_b"))).select("id", "text_a", "text_b")


#: Words and markers of all kinds, looked for in one pass.
_TERMS = list(dict.fromkeys([*sorted(L.STOPWORDS), *L.QUESTION_MARKERS, *L.RESPONSE_MARKERS, *L.CONTRAST_MARKERS, *L.REVISION_MARKERS]))


@query("terms_found", f"WITH {turns_sql(True)} SELECT id, array_to_string({_found('turn_text', _TERMS, len(_TERMS))}, '|') AS terms FROM turns")
def terms_found(spark, sf_dir):
    return with_terms_in(turns(spark, sf_dir, True), "turn_text", _TERMS).select("id", F.array_join("terms", "|").alias("terms"))


@query("term_counts", f"WITH {turns_sql(True)} SELECT m AS term, count(*) AS n_texts FROM (SELECT unnest({_found('turn_text', _TERMS, len(_TERMS))}) AS m FROM turns) GROUP BY 1")
def counts_of_terms(spark, sf_dir):
    return term_counts(turns(spark, sf_dir, True), "turn_text", _TERMS)


@query("contrast_response", f"WITH {turns_sql(True)}, {_PAIRS}, m AS (SELECT id, {_found('text_b', L.CONTRAST_MARKERS)} AS markers FROM pairs) SELECT id, array_to_string(markers, '|') AS markers FROM m WHERE len(markers) > 0")
def contrast_response(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("m", P.contrast(F.col("text_b"))).where("size(m) > 0").select("id", F.array_join("m", "|").alias("markers"))


def _stop(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]"


@query(
    "resonance_tokens",
    f"""WITH {turns_sql(True)}, h AS (SELECT id, turn_text AS t, regexp_replace(turn_text, '[^一-鿿]+', '', 'g') AS han FROM turns),
c AS (SELECT id, list_filter(regexp_extract_all(t, '[A-Za-z0-9_]{{2,}}|[一-鿿]{{2,6}}'), lambda x: NOT list_contains({_stop(L.STOPWORDS)}, x)) AS chunks,
  list_filter(list_transform(range(1, length(han)), lambda i: substr(han, CAST(i AS BIGINT), 2)), lambda x: NOT regexp_matches(x, '[{"".join(sorted(L.STOP_CHARS))}]') AND NOT list_contains({_stop(L.STOPWORDS)}, x)) AS grams FROM h),
a AS (SELECT id, list_concat(chunks, grams) AS found FROM c)
SELECT id, array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i)[1:24], '|') AS tokens FROM a""",
)
def tokens(spark, sf_dir):
    return turns(spark, sf_dir, True).select("id", F.array_join(resonance_tokens(F.col("turn_text")), "|").alias("tokens"))


@query("shared_phrases", f"WITH {turns_sql(True)}, {_PAIRS}, {phrases_sql()} SELECT p.id, array_to_string(s.shared, '|') AS terms FROM pairs p JOIN said s ON s.text_a = p.text_a AND s.text_b = p.text_b")
def shared(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", F.array_join(P.shared_phrases("text_a", "text_b"), "|").alias("terms"))


_FLAG_LIST = ", ".join(f"f.{c}" for c in L.FLAGS.values())


@query("pair_features", f"WITH {turns_sql(True)}, {_PAIRS}, {features_sql()} SELECT p.*, t.entry_id, array_to_string(f.shared_terms, '|') AS shared_terms, array_to_string(f.markers, '|') AS markers, {_FLAG_LIST} FROM pairs p JOIN feats f ON f.id = p.id JOIN turns t ON t.id = p.id")
def features(spark, sf_dir):
    return P.with_features(_pairs(spark, sf_dir)).withColumns({c: F.array_join(c, "|") for c in ("shared_terms", "markers")})


@query("pair_flag_totals", f"WITH {turns_sql(True)}, {_PAIRS}, {features_sql()} SELECT count(*) AS n_pairs, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in L.FLAGS.values()) + " FROM feats")
def flag_totals(spark, sf_dir):
    return P.flag_totals(P.with_features(_pairs(spark, sf_dir)))


@query("resonance_contrast_page", f"WITH {turns_sql(True)}, {_PAIRS} SELECT id, text_a, text_b FROM pairs WHERE len({_found('text_b', L.CONTRAST_MARKERS)}) > 0 AND (text_a LIKE '%明天%' OR text_b LIKE '%公园%' OR text_a LIKE '%公园%' OR text_b LIKE '%明天%') AND (text_a LIKE '%公园%' OR text_b LIKE '%公园%') ORDER BY id DESC LIMIT 20")
def resonance_contrast_page(spark, sf_dir):
    return P.resonance_page(P.with_features(_pairs(spark, sf_dir)), "contrast", 20, keyword="公园").select("id", "text_a", "text_b")


@query("resonance_page", f"WITH {turns_sql(True)}, {_PAIRS}, {features_sql()} SELECT p.id, p.text_a, p.text_b FROM pairs p JOIN feats f ON f.id = p.id WHERE p.id < 90000000 AND (" + " OR ".join(f"f.{c} = 1" for c in L.PRESET_FLAGS["resonance"]) + ") ORDER BY p.id DESC LIMIT 50")
def resonance_page(spark, sf_dir):
    return P.resonance_page(P.with_features(_pairs(spark, sf_dir)), "resonance", 50, cursor=90_000_000).select("id", "text_a", "text_b")


def _contrasts() -> str:
    return f"SELECT *, array_to_string({_found('text_b', L.CONTRAST_MARKERS)}, ' / ') AS m FROM pairs WHERE len({_found('text_b', L.CONTRAST_MARKERS)}) > 0"


@query("resonance_explained", f"WITH {turns_sql(True)}, {_PAIRS}, c AS ({_contrasts()}) SELECT id, '{L.CONTRASTS}' || m AS explanation FROM c")
def resonance_explained(spark, sf_dir):
    p = P.with_features(_pairs(spark, sf_dir)).withColumn("x", P.explanation("contrast"))
    return p.where("x IS NOT NULL").select("id", "x.explanation")


@query("resonance_questions", f"WITH {turns_sql(True)}, {_PAIRS} SELECT id, array_to_string({_found('text_a', L.QUESTION_MARKERS, 3)}, '|') AS terms, '{L.ANSWERS}' AS explanation FROM pairs WHERE ({_ASKED}) AND ({_ANSWERED} OR length(text_b) >= 8)")
def resonance_questions(spark, sf_dir):
    p = P.with_features(_pairs(spark, sf_dir)).withColumn("x", P.explanation("qa_response"))
    return p.where("x IS NOT NULL").select("id", F.array_join("x.terms", "|").alias("terms"), "x.explanation")


_SCAN = f"""c AS ({_contrasts()}), o AS (SELECT *, row_number() OVER (ORDER BY id DESC) AS k, count(*) OVER () AS total FROM c WHERE id < 15000000),
p AS (SELECT *, min(id) OVER () AS last FROM o WHERE k <= 7)"""


@query("resonance_scan", f"WITH {turns_sql(True)}, {_PAIRS}, {_SCAN} SELECT id, total > 7 AS has_next, CASE WHEN total > 7 THEN last END AS next_cursor, '{L.CONTRASTS}' || m AS explanation FROM p")
def resonance_scan(spark, sf_dir):
    return P.resonance_scan(P.with_features(_pairs(spark, sf_dir)), "contrast", "7", cursor=15_000_000).select("id", "has_next", "next_cursor", "explanation")


@query("resonance_rows", f"WITH {turns_sql(True)}, {_PAIRS} SELECT p.id, coalesce(e.title, '') AS entry_title, e.year, coalesce(nullif(e.crawl_source, ''), nullif(p.dataset_name, ''), nullif(p.category, ''), '') AS origin, printf('%s · %d-%d', p.conversation_key, p.turn_index_a, p.turn_index_b) AS fragment, CASE WHEN p.source = '{L.TEXT_DIALOGUE}' AND p.category IN {L.ANCIENT_CATEGORIES} THEN '{L.ANCIENT}' ELSE p.source END AS section FROM pairs p JOIN turns b ON b.id = p.id LEFT JOIN entries e ON e.id = b.entry_id")
def resonance_rows(spark, sf_dir):
    return P.with_entries(_pairs(spark, sf_dir), entries(spark, sf_dir)).select("id", "entry_title", "year", "origin", "fragment", "section")


@query("diagraph_payloads")
def diagraph_payloads(spark, sf_dir):
    p = P.payloads(P.with_features(_pairs(spark, sf_dir)), turns(spark, sf_dir, True), "context2")
    return p.select("pair_id", "window", F.array_join("columns", "|").alias("columns"), F.size("grid").alias("n_rows"), F.size("turns").alias("n_turns"), F.to_json("affordances").alias("affordances"), F.array_join("supported", "|").alias("supported"))


@query("terms_from_json", f"WITH {turns_sql(True)}, {_PAIRS} SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE array_to_string({_found('text_b', L.CONTRAST_MARKERS)}, '|') END AS terms FROM pairs")
def read_terms(spark, sf_dir):
    stored = F.when(F.col("id") % 3 == 0, F.lit("[broken")).otherwise(F.to_json(P.contrast(F.col("text_b"))))
    return _pairs(spark, sf_dir).select("id", F.array_join(terms_from_json(stored), "|").alias("terms"))


_SHOW = ("src1-en", "src2-en", "src3-en")


@query(
    "showcase_round_robin",
    f"""WITH {turns_sql(True)}, {_PAIRS}, f AS (SELECT *, row_number() OVER (PARTITION BY dataset_name ORDER BY id DESC) AS r FROM pairs WHERE dataset_name IN {_SHOW} AND len({_found('text_b', L.CONTRAST_MARKERS)}) > 0
  AND length(text_a) BETWEEN 4 AND 60 AND length(text_b) BETWEEN 2 AND 90 AND length(text_a) + length(text_b) <= 120 AND trim(speaker_a) <> trim(speaker_b))
SELECT id, dataset_name, text_a, text_b FROM f ORDER BY r, list_position({list(_SHOW)}, dataset_name), id DESC LIMIT 20""",
)
def showcase_round_robin(spark, sf_dir):
    return P.showcase_page(P.with_features(_pairs(spark, sf_dir)), _SHOW, "contrast", 20).select("id", "dataset_name", "text_a", "text_b")


@query(
    "diagraph_window",
    f"WITH {turns_sql(True)}, {_PAIRS} SELECT p.id AS pair_id, t.turn_index, t.turn_text FROM pairs p JOIN turns t ON t.conversation_key = p.conversation_key AND t.turn_index BETWEEN p.turn_index_a - 2 AND p.turn_index_b + 2",
)
def diagraph_window(spark, sf_dir):
    return P.window_turns(_pairs(spark, sf_dir), turns(spark, sf_dir, True), "context2").select("pair_id", "turn_index", "turn_text")


@query("adjacent_pairs_stored", f"WITH {turns_sql(True)}, {_PAIRS} SELECT turn_a_id, turn_b_id, conversation_key, text_a, text_b FROM pairs")
def adjacent_pairs_stored(spark, sf_dir):
    """Pairs of turns that are stored by conversation: no shuffle."""
    return P.adjacent_pairs(by_conversation(turns(spark, sf_dir, True), buckets=8)).select("turn_a_id", "turn_b_id", "conversation_key", "text_a", "text_b")


@query(
    "diagraph_window_stored",
    f"WITH {turns_sql(True)}, {_PAIRS} SELECT p.id AS pair_id, t.turn_index, t.turn_text FROM pairs p JOIN turns t ON t.conversation_key = p.conversation_key AND t.turn_index BETWEEN p.turn_index_a - 2 AND p.turn_index_b + 2",
)
def diagraph_window_stored(spark, sf_dir):
    return P.pairs_with_windows(by_conversation(turns(spark, sf_dir, True), buckets=8), "context2").select("pair_id", "turn_index", "turn_text")


@query("conversation_counts", f"WITH {turns_sql(True)} SELECT conversation_key, count(*) AS n_turns, count(DISTINCT speaker_label) AS n_speakers FROM turns GROUP BY 1")
def counts_by_conversation(spark, sf_dir):
    return conversation_counts(by_conversation(turns(spark, sf_dir, True), buckets=8))


@query("diagraph_grid")
def diagraph_grid(spark, sf_dir):
    p = P.with_features(_pairs(spark, sf_dir))
    return P.grid(p, turns(spark, sf_dir, True), "context2").select("pair_id", "row_no", "speaker", F.to_json("cells").alias("cells"))


@query("diagraph_affordances")
def diagraph_affordances(spark, sf_dir):
    return P.described(P.relations(P.with_features(_pairs(spark, sf_dir)), turns(spark, sf_dir, True))).withColumn("mechanisms", F.array_join("mechanisms", "|"))


@query("mechanism_summary")
def mechanism_summary(spark, sf_dir):
    return P.mechanism_summary(P.relations(P.with_features(_pairs(spark, sf_dir)), turns(spark, sf_dir, True)))


@query("relation_scores")
def relation_scores(spark, sf_dir):
    """Support of mechanisms by rules and by a model that is trained on what rules find."""
    p, t = P.with_features(_pairs(spark, sf_dir)), turns(spark, sf_dir, True)
    return P.pair_support(P.relations(p, t), P.relation_scores(p, P.trained_relations(p, t)))
