"""Searches over entries and turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import search as S
from ..operators.grams import GramIndex, search_pattern, search_phrase
from ..operators.search import SearchFilters
from ..operators.tables import ENTRIES_SQL, PHRASES, entries, turns, turns_sql
from ..shipping import working_folder
from .registry import query

_ROW = ("id", "title", "source", "year", "category")


def _entry_search(name: str, filters: SearchFilters, where: str) -> None:
    @query(name, f"WITH {ENTRIES_SQL} SELECT id, title, source, year, category FROM entries WHERE {where}")
    def run(spark, sf_dir):
        return S.search_entries(entries(spark, sf_dir), filters).select(*_ROW)


_entry_search("search_contains", SearchFilters("The and"), r"content ILIKE '%The and%'")
_entry_search("search_exact", SearchFilters("doc 12", mode="exact", field="title"), "title ILIKE 'doc 12'")
_entry_search("search_starts_with", SearchFilters("The", mode="starts_with"), "content ILIKE 'The%'")
_entry_search("search_ends_with", SearchFilters("tion.", mode="ends_with"), "content ILIKE '%tion.'")
_entry_search("search_regex", SearchFilters(r"th[ae]n\s+of", mode="regex"), r"regexp_matches(content, '(?i)th[ae]n\s+of')")
_entry_search("search_regex_literal_rewrite", SearchFilters("th(is|at) of", mode="regex"), "content ILIKE '%this of%' OR content ILIKE '%that of%'")
_entry_search("search_regex_prefilter", SearchFilters("token = .{1}[0-9a-f]{4}", mode="regex"), "regexp_matches(content, '(?i)token = .{1}[0-9a-f]{4}')")
_entry_search("search_regex_full_width", SearchFilters("th（is｜at） of"), "content ILIKE '%this of%' OR content ILIKE '%that of%'")
_entry_search("search_regex_rejected", SearchFilters("(a+)+", mode="regex"), "false")
_entry_search("search_field_all", SearchFilters("Doc 3", field="all"), "title ILIKE '%Doc 3%' OR content ILIKE '%Doc 3%'")
_entry_search("search_like_escape", SearchFilters("%%%"), r"content LIKE '%\%\%\%%' ESCAPE '\'")
_entry_search("search_exclude", SearchFilters("tion", exclude="license"), "content ILIKE '%tion%' AND NOT (title ILIKE '%license%' OR content ILIKE '%license%')")
_entry_search("search_year_equals", SearchFilters(year="2003"), "year = 2003")
_entry_search("search_year_range", SearchFilters(year_from="2003", year_to=" 2006 "), "year BETWEEN 2003 AND 2006")
_entry_search("search_year_ignored", SearchFilters("tion", year_from="soon"), "content ILIKE '%tion%'")
_entry_search("search_length_range", SearchFilters(content_min="500", content_max="900"), "length(content) BETWEEN 500 AND 900")
_entry_search("search_dataset", SearchFilters(dataset_name="src3-en"), "dataset_name = 'src3-en'")
_entry_search("search_has_audio", SearchFilters(has_audio=True), "trim(audio_file) <> ''")
_entry_search("search_title", SearchFilters(title="c 4"), "title ILIKE '%c 4%'")
_entry_search("search_display_source", SearchFilters(source=L.ANCIENT), f"source = '{L.TEXT_DIALOGUE}' AND category IN {L.ANCIENT_CATEGORIES}")
_entry_search("search_display_category", SearchFilters(source=L.TEXT_DIALOGUE, category=L.MODERN_CATEGORIES[0]), f"source = '{L.TEXT_DIALOGUE}' AND category = '{L.MODERN_CATEGORIES[0]}'")
_entry_search("search_display_mismatch", SearchFilters(source=L.ANCIENT, category=L.MODERN_CATEGORIES[0]), "false")
_entry_search("search_stored_source", SearchFilters(source=L.SECTION_ORDER[0], category="en"), f"source = '{L.SECTION_ORDER[0]}' AND category = 'en'")


_entry_search("search_regex_tab", SearchFilters(r"\.\n[A-Z]\x65", mode="regex"), r"regexp_matches(content, '(?i)\.\n[A-Z]e')")
_entry_search("search_regex_escapes", SearchFilters(r"of\x20the\x20(?:in|on)", mode="regex"), "content ILIKE '%of the in%' OR content ILIKE '%of the on%'")
_entry_search("search_from_args", SearchFilters.from_args({"keyword": " tion ", "year_from": "2003", "mode": "sideways", "has_audio": "on", "page": "4"}), "content ILIKE '%tion%' AND year >= 2003 AND audio_file IS NOT NULL")


def _wide(spark, sf_dir):
    """Entries with speakers, segments and start times."""
    e = entries(spark, sf_dir)
    return e.withColumns({"speaker": F.concat(F.lit("spk"), F.col("id") % 7), "current_segment": F.substring("content", 1, 40), "segment_text": F.substring("content", 41, 40), "start_time": F.when(F.col("id") % 3 > 0, (F.col("id") * 37 % 101).cast("double")), "search_text": F.concat_ws(" ", "title", "content", F.concat(F.lit("spk"), F.col("id") % 7))})


_WIDE = f"{ENTRIES_SQL}, wide AS (SELECT *, 'spk' || id % 7 AS speaker, substr(content, 1, 40) AS current_segment, substr(content, 41, 40) AS segment_text, CASE WHEN id % 3 > 0 THEN CAST(id * 37 % 101 AS DOUBLE) END AS start_time FROM entries)"


@query("search_speaker_field", f"WITH {_WIDE} SELECT id FROM wide WHERE speaker ILIKE '%K3%' AND (current_segment ILIKE '%th%' OR segment_text ILIKE '%th%')")
def search_speaker_field(spark, sf_dir):
    return S.search_entries(_wide(spark, sf_dir), SearchFilters("th", field="segment", speaker="K3")).select("id")


@query("search_joined_text", f"WITH {_WIDE} SELECT id FROM wide WHERE title || ' ' || content || ' ' || speaker ILIKE '%. spk%' AND NOT title || ' ' || content || ' ' || speaker ILIKE '%spk5%'")
def search_joined_text(spark, sf_dir):
    e = _wide(spark, sf_dir)
    return e.where(S.entry_condition(e, SearchFilters(". spk", field="all", exclude="spk5"), joined=True)).select("id")


@query("search_sort_start_time_asc", f"WITH {_WIDE} SELECT id, start_time FROM wide WHERE content ILIKE '%tion%' ORDER BY start_time ASC NULLS FIRST, id DESC LIMIT 25")
def search_sort_start_time(spark, sf_dir):
    return S.search_entries(_wide(spark, sf_dir), SearchFilters("tion", sort="start_time_asc"), 25).select("id", "start_time")


def _turn_sorted(sort: str, order: str) -> None:
    @query(f"turn_search_sort_{sort}", f"WITH {turns_sql()}, {_WIDE.removeprefix(ENTRIES_SQL + ', ')} SELECT t.id, e.title, e.start_time FROM turns t JOIN wide e ON e.id = t.entry_id WHERE t.turn_text ILIKE '%that%' ORDER BY {order} LIMIT 30")
    def run(spark, sf_dir):
        f = SearchFilters("that", sort=sort, has_audio=False, year_from="0")
        return S.turn_hits(turns(spark, sf_dir), _wide(spark, sf_dir), f).orderBy(*S.entry_order(f.sort, nulls_last=True)).limit(30).select("id", "title", "start_time")


for _sort, _order in (("id_desc", "t.id DESC"), ("id_asc", "t.id"), ("year_asc", "e.year ASC NULLS LAST, t.id DESC"), ("title_asc", "coalesce(e.title, '') ASC, t.id DESC"), ("start_time_asc", "e.start_time ASC NULLS LAST, t.id DESC")):
    _turn_sorted(_sort, _order)


def _index(spark, e):
    index = GramIndex(spark, working_folder(spark, "grams"), 16)
    index.put(e)
    return index


@query("search_indexed", f"WITH {ENTRIES_SQL} SELECT id, title FROM entries WHERE title ILIKE '%Tion the%' OR content ILIKE '%Tion the%'")
def search_indexed(spark, sf_dir):
    """A phrase, answered from a stored index of the whole table."""
    e = entries(spark, sf_dir)
    return search_phrase(e, _index(spark, e), "Tion the").select("id", "title")


@query("search_indexed_regex", f"WITH {ENTRIES_SQL} SELECT id, title FROM entries WHERE regexp_matches(content, '(?i)(license|licen[cs]ed) [a-z]+ +t(hat|his)')")
def search_indexed_regex(spark, sf_dir):
    """A regular expression, answered from the grams that its matches must have."""
    e = entries(spark, sf_dir)
    return search_pattern(e, _index(spark, e), "(license|licen[cs]ed) [a-z]+ +t(hat|his)").select("id", "title")


_CHANGED = "CASE WHEN year >= 2015 THEN replace(content, 'the', 'zebra') ELSE content END"


@query("search_indexed_changed", f"WITH {ENTRIES_SQL}, now AS (SELECT id, {_CHANGED} AS content FROM entries WHERE year >= 2003) SELECT id, regexp_matches(content, '(?i)zebra (in|on)') AS by_pattern FROM now WHERE content ILIKE '%zebra%' OR content ILIKE '%and the%'")
def search_indexed_changed(spark, sf_dir):
    """An index after two more batches: entries that change, and entries that go."""
    e = entries(spark, sf_dir)
    index = _index(spark, e)
    now = e.withColumn("content", F.when(F.col("year") >= 2015, F.replace("content", F.lit("the"), F.lit("zebra"))).otherwise(F.col("content")))
    index.put(now.where("year >= 2015"))
    index.delete(e.where("year < 2003"))
    now = now.where("year >= 2003")
    # the changed titles hold neither phrase
    found = search_phrase(now, index, "zebra").select("id").union(search_phrase(now, index, "and the").select("id")).distinct()
    return found.join(search_pattern(now, index, "zebra (in|on)").select("id", F.lit(True).alias("by")), "id", "left").select("id", F.coalesce("by", F.lit(False)).alias("by_pattern"))


@query("candidate_turns", f"WITH {turns_sql(True)} SELECT id, turn_text FROM turns WHERE turn_text LIKE '%公园%' AND id < 15000000 AND source = '{L.SECTION_ORDER[0]}' ORDER BY id DESC LIMIT 40")
def candidate_turns(spark, sf_dir):
    return S.candidate_turns(turns(spark, sf_dir, True), "公园", " 40 ", source=L.SECTION_ORDER[0], before_id=15_000_000).select("id", "turn_text")


@query("search_fts_phrase", f"WITH {ENTRIES_SQL} SELECT id, title FROM entries WHERE title ILIKE '%and the%' OR content ILIKE '%and the%'")
def search_fts_phrase(spark, sf_dir):
    e = entries(spark, sf_dir)
    return e.where(S.fts_condition(e, "and the")).select("id", "title")


@query(
    "search_filter_steps",
    f"""WITH {ENTRIES_SQL}, c AS (SELECT count(*) AS a, count(*) FILTER (content ILIKE '%tion%') AS b, count(*) FILTER (content ILIKE '%tion%' AND year >= 2010) AS c, count(*) FILTER (content ILIKE '%tion%' AND year >= 2010 AND NOT (title ILIKE '%license%' OR content ILIKE '%license%')) AS d FROM entries)
SELECT 1 AS place, 'keyword' AS step, a AS rows_in, a - b AS rows_removed FROM c UNION ALL SELECT 2, 'year_from', b, b - c FROM c UNION ALL SELECT 3, 'exclude', c, c - d FROM c""",
)
def search_filter_steps(spark, sf_dir):
    return S.filter_steps(entries(spark, sf_dir), SearchFilters("tion", year_from=2010, exclude="license"))


@query("search_count", f"WITH {ENTRIES_SQL} SELECT count(*) AS n FROM entries WHERE content ILIKE '%tion%' AND year >= 2010")
def search_count(spark, sf_dir):
    return S.count_entries(entries(spark, sf_dir), SearchFilters("tion", year_from=2010))


def _sorted(sort: str, order: str) -> None:
    @query(f"search_sort_{sort}", f"WITH {ENTRIES_SQL} SELECT id, title, year FROM entries WHERE content ILIKE '%tion%' ORDER BY {order} LIMIT 25")
    def run(spark, sf_dir):
        return S.search_entries(entries(spark, sf_dir), SearchFilters("tion", sort=sort), 25).select("id", "title", "year")


_sorted("id_desc", "id DESC")
_sorted("id_asc", "id")
_sorted("year_desc", "year DESC NULLS LAST, id DESC")
_sorted("year_asc", "year ASC NULLS FIRST, id DESC")
_sorted("title_asc", "title ASC NULLS FIRST, id DESC")


@query("search_page", f"WITH {ENTRIES_SQL} SELECT id, title FROM entries WHERE content ILIKE '%tion%' ORDER BY id DESC LIMIT 20 OFFSET 40")
def search_page(spark, sf_dir):
    return S.search_entries(entries(spark, sf_dir), SearchFilters("tion"), 20, 40).select("id", "title")


@query("search_cursor_page", f"WITH {turns_sql()} SELECT id, turn_text FROM turns WHERE id < 90000000 AND turn_text ILIKE '%the%' ORDER BY id DESC LIMIT 21")
def search_cursor_page(spark, sf_dir):
    t = turns(spark, sf_dir)
    return S.newest_in_order(t.where((F.col("id") < 90_000_000) & S.ilike(F.col("turn_text"), "the")), 21).select("id", "turn_text")


_HITS = "hits AS (SELECT * FROM turns WHERE turn_text ILIKE '%tion%' ORDER BY id DESC LIMIT 50)"
_NEAR = "LEFT JOIN turns p ON p.conversation_key = h.conversation_key AND p.turn_index = h.turn_index - 1 LEFT JOIN turns n ON n.conversation_key = h.conversation_key AND n.turn_index = h.turn_index + 1"


@query(
    "turn_search_neighbors",
    f"""WITH {turns_sql()}, {_HITS} SELECT h.id, h.entry_id, h.conversation_key, h.turn_index, h.speaker_label, coalesce(p.turn_text, '') AS prev_text, h.turn_text AS hit_text,
  coalesce(n.turn_text, '') AS next_text, coalesce(e.title, '') AS title, e.year,
  CASE WHEN e.source = '{L.TEXT_DIALOGUE}' AND e.category IN {L.ANCIENT_CATEGORIES} THEN '{L.ANCIENT}' ELSE coalesce(e.source, '') END AS source,
  coalesce(e.category, '') AS category, coalesce(e.dataset_name, '') AS dataset_name FROM hits h {_NEAR} LEFT JOIN entries e ON e.id = h.entry_id""",
)
def turn_search_neighbors(spark, sf_dir):
    return S.search_turns(turns(spark, sf_dir), entries(spark, sf_dir), SearchFilters("tion"), 50)


@query(
    "turn_search_entry_join",
    f"WITH {turns_sql()} SELECT t.id, t.turn_text, e.title, e.year FROM turns t JOIN entries e ON e.id = t.entry_id WHERE t.turn_text ILIKE '%tion%' AND e.year >= 2005 AND t.speaker_label ILIKE '%user%' AND NOT t.turn_text ILIKE '%thand%'",
)
def turn_search_entry_join(spark, sf_dir):
    return S.turn_hits(turns(spark, sf_dir), entries(spark, sf_dir), SearchFilters("tion", year_from=2005, speaker="user", exclude="thand")).select("id", "turn_text", "title", "year")


@query("turn_search_without_keyword", f"WITH {turns_sql()} SELECT id, turn_text FROM turns WHERE false")
def turn_search_without_keyword(spark, sf_dir):
    return S.turn_hits(turns(spark, sf_dir), entries(spark, sf_dir), SearchFilters()).select("id", "turn_text")


@query("turn_search_count", f"WITH {turns_sql()} SELECT count(*) AS n FROM turns WHERE turn_text ILIKE '%that%'")
def turn_search_count(spark, sf_dir):
    return S.turn_hits(turns(spark, sf_dir), entries(spark, sf_dir), SearchFilters("that")).agg(F.count(F.lit(1)).alias("n"))


@query("turn_search_year_order", f"WITH {turns_sql()} SELECT t.id, e.year FROM turns t JOIN entries e ON e.id = t.entry_id WHERE t.turn_text ILIKE '%that%' ORDER BY e.year DESC NULLS LAST, t.id DESC LIMIT 30")
def turn_search_year_order(spark, sf_dir):
    f = SearchFilters("that", sort="year_desc")
    return S.turn_hits(turns(spark, sf_dir), entries(spark, sf_dir), f).orderBy(*S.entry_order(f.sort, nulls_last=True)).limit(30).select("id", "year")


@query("conversation_refs", f"WITH {turns_sql()} SELECT conversation_key, max(id) AS first_hit, count(*) AS n_hits FROM turns WHERE turn_text ILIKE '%tion%' GROUP BY ALL")
def conversation_refs(spark, sf_dir):
    return S.first_of_conversations(S.turn_hits(turns(spark, sf_dir), entries(spark, sf_dir), SearchFilters("tion")))


@query("dialogue_match_count", f"WITH {turns_sql()} SELECT conversation_key, count(*) FILTER (turn_text ILIKE '%that%') AS n_hits, count(*) AS n_turns FROM turns GROUP BY ALL HAVING n_hits > 0")
def dialogue_match_count(spark, sf_dir):
    return S.match_counts(turns(spark, sf_dir), "that")


@query(
    "kwic",
    f"""WITH {turns_sql()}, m AS (SELECT id, turn_text, strpos(turn_text, 'tion') AS p FROM turns WHERE turn_text ILIKE '%tion%')
SELECT id, CASE WHEN p > 0 THEN substr(turn_text, greatest(p - 30, 1), p - greatest(p - 30, 1)) ELSE substr(turn_text, 1, 30) END AS left_context, CASE WHEN p > 0 THEN 'tion' ELSE '' END AS hit,
  CASE WHEN p > 0 THEN substr(turn_text, p + 4, 30) ELSE substr(turn_text, 31, 30) END AS right_context FROM m""",
)
def kwic(spark, sf_dir):
    hits = S.turn_hits(turns(spark, sf_dir), entries(spark, sf_dir), SearchFilters("tion"))
    return S.kwic(hits, "turn_text", "tion").select("id", "left_context", "hit", "right_context")


@query(
    "kwic_regex",
    f"""WITH {turns_sql()}, m AS (SELECT id, turn_text AS t, regexp_extract(turn_text, '(?i)t[hi]on?\\.? [a-m]') AS h FROM turns), p AS (SELECT *, CASE WHEN h <> '' THEN strpos(t, h) ELSE 0 END AS place FROM m)
SELECT id, CASE WHEN place > 0 THEN substr(t, greatest(place - 30, 1), place - greatest(place - 30, 1)) ELSE substr(t, 1, 30) END AS left_context, h AS hit, CASE WHEN place > 0 THEN substr(t, place + length(h), 30) ELSE substr(t, 31, 30) END AS right_context FROM p""".replace("\\\\", "\\"),
)
def kwic_regex(spark, sf_dir):
    return S.kwic_regex(turns(spark, sf_dir), "turn_text", r"t[hi]on?\.? [a-m]").select("id", "left_context", "hit", "right_context")


@query(
    "sequence_adjacent_candidates",
    f"""WITH {turns_sql(True)}, h AS (SELECT id FROM turns WHERE turn_text ILIKE '%{PHRASES[0][1:4]}%' ORDER BY id DESC LIMIT 300)
SELECT DISTINCT a.id AS turn_a_id, b.id AS turn_b_id, a.turn_text AS text_a, b.turn_text AS text_b FROM turns a JOIN turns b ON b.conversation_key = a.conversation_key AND b.turn_index = a.turn_index + 1
WHERE a.id IN (SELECT id FROM h) OR b.id IN (SELECT id FROM h)""",
)
def sequence_adjacent_candidates(spark, sf_dir):
    return S.candidate_pairs(turns(spark, sf_dir, True), PHRASES[0][1:4]).select("turn_a_id", "turn_b_id", "text_a", "text_b")
