"""Statistics, options and browsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import display_title, entry_context, format_count, fragment_label, origin_label
from ..operators import ingest as I
from ..operators import pairs as P
from ..operators import results as R
from ..operators import statistics as St
from ..operators.results import audio_url
from ..operators.search import SearchFilters, exists, ilike, lookup, page_of_turns, turn_hits
from ..operators.tables import ENTRIES_SQL, PHRASES, SCHEMAS, columns_of, conform, create_tables, entries, pick, plan_facts, table, table_facts, turns, turns_sql
from ..shipping import working_folder
from .registry import query

_SECTION = f"CASE WHEN source = '{L.TEXT_DIALOGUE}' AND category IN {L.ANCIENT_CATEGORIES} THEN '{L.ANCIENT}' ELSE coalesce(source, '') END"


def _detail(*names: str, where: str = "", entries: str = "entries", turns: str = "turns") -> str:
    by = ", ".join(names)
    both = ", ".join(f"coalesce(e.{n}, t.{n}) AS {n}" for n in names)
    on = " AND ".join(f"e.{n} = t.{n}" for n in names)
    return f"""e AS (SELECT {by}, count(*) AS ne FROM {entries} {where} GROUP BY ALL), t AS (SELECT {by}, count(*) AS nt, count(DISTINCT conversation_key) AS nc FROM {turns} {where} GROUP BY ALL),
found AS (SELECT {both}, coalesce(ne, 0) AS n_entries, coalesce(nc, ne, 0) AS n_conversations, coalesce(nt, 0) AS n_turns FROM e FULL JOIN t ON {on})"""


_SECTIONS = f"""se AS (SELECT unnest(list_distinct([source, {_SECTION}])) AS section, id FROM entries), su AS (SELECT unnest(list_distinct([source, {_SECTION}])) AS section, conversation_key FROM turns),
{_detail('section', entries='se', turns='su')}"""


@query("scan_newest", f"WITH {ENTRIES_SQL} SELECT id, title, source, year, category FROM entries ORDER BY id DESC LIMIT 50 OFFSET 10")
def scan_newest(spark, sf_dir):
    return entries(spark, sf_dir).select("id", "title", "source", "year", "category").orderBy(F.desc("id")).offset(10).limit(50)


@query("scan_after_key", f"WITH {ENTRIES_SQL} SELECT id, title FROM entries WHERE id > 100 ORDER BY id LIMIT 40")
def scan_after_key(spark, sf_dir):
    return entries(spark, sf_dir).where("id > 100").orderBy("id").limit(40).select("id", "title")


@query("point_lookup", f"WITH {ENTRIES_SQL} SELECT id, title, category FROM entries WHERE id = 77")
def point_lookup(spark, sf_dir):
    return entries(spark, sf_dir).where("id = 77").limit(1).select("id", "title", "category")


@query("stats_by_source", f"WITH {ENTRIES_SQL} SELECT source, count(*) AS n FROM entries GROUP BY ALL")
def stats_by_source(spark, sf_dir):
    return St.counts_by(entries(spark, sf_dir), "source")


@query("stats_by_category", f"WITH {ENTRIES_SQL} SELECT {_SECTION} AS section, category, count(*) AS n FROM entries GROUP BY ALL")
def stats_by_category(spark, sf_dir):
    return St.counts_by(entries(spark, sf_dir).withColumn("section", St.section_column()), "section", "category")


@query("stats_by_dataset", f"WITH {turns_sql()} SELECT dataset_name, category, count(*) AS n_turns, count(DISTINCT conversation_key) AS n_conversations FROM turns GROUP BY ALL")
def stats_by_dataset(spark, sf_dir):
    return turns(spark, sf_dir).groupBy("dataset_name", "category").agg(F.count(F.lit(1)).alias("n_turns"), F.countDistinct("conversation_key").alias("n_conversations"))


@query(
    "section_stats",
    f"WITH {turns_sql()}, {_SECTIONS} SELECT * FROM found",
)
def section_stats(spark, sf_dir):
    return St.section_stats(entries(spark, sf_dir), turns(spark, sf_dir))


_ASKED = (*L.SECTION_ORDER, "没有")


@query("section_stats_asked", f"WITH {turns_sql()}, {_SECTIONS} SELECT a.section, coalesce(n_entries, 0) AS n_entries, coalesce(n_conversations, 0) AS n_conversations, coalesce(n_turns, 0) AS n_turns FROM (SELECT unnest({list(_ASKED)}) AS section) a LEFT JOIN found f ON f.section = a.section")
def section_stats_asked(spark, sf_dir):
    return St.section_stats(entries(spark, sf_dir), turns(spark, sf_dir), _ASKED)


@query("category_detail", f"WITH {turns_sql()}, {_detail('category', where=f"WHERE source = '{L.TEXT_DIALOGUE}'")} SELECT * FROM found")
def category_detail(spark, sf_dir):
    return St.category_stats(entries(spark, sf_dir), turns(spark, sf_dir), L.TEXT_DIALOGUE)


@query("dataset_detail", f"WITH {turns_sql()}, {_detail('dataset_name', 'category')} SELECT * FROM found")
def dataset_detail(spark, sf_dir):
    return St.dataset_stats(entries(spark, sf_dir), turns(spark, sf_dir))


@query("grand_total", f"WITH {ENTRIES_SQL}, s AS (SELECT unnest(list_distinct([source, {_SECTION}])) AS section FROM entries) SELECT count(*) AS n FROM s")
def grand_total(spark, sf_dir):
    return St.section_stats(entries(spark, sf_dir), turns(spark, sf_dir)).agg(F.sum("n_entries").alias("n"))


@query("table_counts", f"WITH {turns_sql()} SELECT (SELECT count(*) FROM entries) AS n_entries, (SELECT count(*) FROM turns) AS n_turns")
def table_counts(spark, sf_dir):
    return entries(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_entries")).join(turns(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_turns")))


@query("character_totals", f"WITH {turns_sql()} SELECT (SELECT sum(length(content)) FROM entries) AS content_chars, (SELECT sum(length(turn_text)) FROM turns) AS turn_chars")
def character_totals(spark, sf_dir):
    return entries(spark, sf_dir).agg(F.sum(F.length("content")).alias("content_chars")).join(turns(spark, sf_dir).agg(F.sum(F.length("turn_text")).alias("turn_chars")))


@query(
    "conditional_counts",
    f"WITH {ENTRIES_SQL} SELECT dataset_name, count(*) AS n, count(*) FILTER (audio_file IS NOT NULL) AS with_audio, sum(CASE WHEN year >= 2010 THEN 1 ELSE 0 END) AS recent FROM entries GROUP BY ALL",
)
def conditional_counts(spark, sf_dir):
    return entries(spark, sf_dir).groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("audio_file").isNotNull()).alias("with_audio"), F.sum((F.col("year") >= 2010).cast("int")).alias("recent"))


@query(
    "filter_options",
    f"""WITH {ENTRIES_SQL}, o AS (SELECT 'source' AS kind, source AS value FROM entries UNION SELECT 'source', {_SECTION} FROM entries UNION SELECT 'category', category FROM entries UNION SELECT 'year', CAST(year AS VARCHAR) FROM entries)
SELECT * FROM o WHERE trim(value) <> '' UNION ALL SELECT 'dataset', dataset_name FROM (SELECT DISTINCT dataset_name FROM entries ORDER BY 1 LIMIT 300)""",
)
def filter_options(spark, sf_dir):
    return St.filter_options(entries(spark, sf_dir))


@query(
    "source_category_map",
    f"""WITH {ENTRIES_SQL}, r AS (SELECT DISTINCT {_SECTION} AS source, category FROM entries UNION SELECT DISTINCT '__all__', category FROM entries)
SELECT source, string_agg(category, '|' ORDER BY category) AS categories FROM r GROUP BY source""",
)
def source_category_map(spark, sf_dir):
    return St.source_categories(entries(spark, sf_dir)).select("source", F.array_join("categories", "|").alias("categories"))


@query(
    "rebuild_state",
    f"""WITH {turns_sql()} SELECT (SELECT count(*) FROM entries) AS n_entries, (SELECT max(id) FROM entries) AS max_entry, count(*) AS n_turns, coalesce(max(entry_id), 0) AS max_turn_entry,
  count(DISTINCT entry_id) AS n_done, CAST(coalesce(max(entry_id), 0) >= (SELECT max(id) FROM entries) AS INTEGER) AS complete FROM turns""",
)
def rebuild_state(spark, sf_dir):
    return St.rebuild_state(entries(spark, sf_dir), turns(spark, sf_dir))


@query("browse_conversations_latest", f"WITH {ENTRIES_SQL} SELECT 'entry:' || id AS conversation_key, id, title, source FROM entries WHERE dataset_name = 'src1-en' AND content ILIKE '%the%' ORDER BY id DESC LIMIT 20")
def browse_conversations_latest(spark, sf_dir):
    return St.latest_of_conversations(entries(spark, sf_dir), dataset="src1-en", keyword="the").orderBy(F.desc("id")).limit(20).select("conversation_key", "id", "title", "source")


@query("browse_count", f"WITH {ENTRIES_SQL} SELECT count(DISTINCT 'entry:' || id) AS n FROM entries WHERE source = '{L.TEXT_DIALOGUE}' AND category IN {L.ANCIENT_CATEGORIES}")
def browse_count(spark, sf_dir):
    return St.latest_of_conversations(entries(spark, sf_dir), source=L.ANCIENT).agg(F.count(F.lit(1)).alias("n"))


@query(
    "browse_dialogue_assembly",
    f"""WITH {turns_sql()} SELECT t.conversation_key, max(coalesce(nullif(e.title, ''), t.conversation_key)) AS title, count(*) AS turn_count, string_agg(speaker_label || ':' || turn_text, chr(10) ORDER BY turn_index) AS body
FROM turns t JOIN entries e ON e.id = t.entry_id GROUP BY t.conversation_key""",
)
def browse_dialogue_assembly(spark, sf_dir):
    c = entries(spark, sf_dir).select(F.concat(F.lit("entry:"), "id").alias("conversation_key"), "title")
    d = St.dialogues(c, turns(spark, sf_dir)).where("turn_count > 0")
    return d.select("conversation_key", "title", F.col("turn_count").cast("long").alias("turn_count"), F.array_join(F.transform("turns", lambda t: F.concat(t["speaker_label"], F.lit(":"), t["turn_text"])), "\n").alias("body"))


@query("browse_first_turn", f"WITH {turns_sql()} SELECT conversation_key, arg_min(turn_text, turn_index) AS first_text FROM turns WHERE trim(turn_text) <> '' GROUP BY ALL")
def browse_first_turn(spark, sf_dir):
    return St.first_turns(turns(spark, sf_dir))


@query("browse_fallback_entries", f"WITH {turns_sql()} SELECT id, title FROM entries e WHERE NOT EXISTS (SELECT 1 FROM turns t WHERE t.entry_id = e.id)")
def browse_fallback_entries(spark, sf_dir):
    return entries(spark, sf_dir).join(turns(spark, sf_dir).select(F.col("entry_id").alias("id")), "id", "left_anti").select("id", "title")


@query("entry_context_truncated", f"WITH {ENTRIES_SQL} SELECT id, CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS context, length(content) > 200 AS truncated FROM entries")
def entry_context_truncated(spark, sf_dir):
    return entries(spark, sf_dir).select("id", entry_context(F.col("content"), 10).alias("c")).select("id", "c.*")  # 200 at least


@query("display_titles", f"WITH {ENTRIES_SQL} SELECT id, {_SECTION} AS source, 'A ' || title AS title, printf('%s · %d-%d', title, 1, 2) AS label FROM entries")
def display_titles(spark, sf_dir):
    title = F.concat(F.lit("  A 合并大对话  "), F.col("title"))
    return entries(spark, sf_dir).select("id", St.section_column().alias("source"), display_title(title).alias("title"), fragment_label(F.col("title"), F.lit(1), F.lit(2)).alias("label"))


@query("section_order", f"WITH {ENTRIES_SQL}, s AS (SELECT DISTINCT {_SECTION} AS section FROM entries) SELECT section, coalesce(list_position({list(L.SECTION_ORDER)}, section), 0) AS place FROM s")
def section_order(spark, sf_dir):
    s = entries(spark, sf_dir).select(St.section_column().alias("section")).distinct()
    return s.select("section", St.section_rank(F.col("section")).cast("int").alias("place"))


@query("formatted_counts", f"WITH {ENTRIES_SQL} SELECT source, format('{{:,}}', sum(length(content))) AS chars FROM entries GROUP BY ALL")
def formatted_counts(spark, sf_dir):
    return entries(spark, sf_dir).groupBy("source").agg(format_count(F.sum(F.length("content"))).alias("chars"))


@query("turn_page", f"WITH {turns_sql()} SELECT id, turn_text FROM turns ORDER BY conversation_key, turn_index, id LIMIT 60 OFFSET 20")
def turn_page(spark, sf_dir):
    return page_of_turns(turns(spark, sf_dir), 60, 20).select("id", "turn_text")


@query("rebuild_state_scope", f"WITH {turns_sql()}, e AS (SELECT * FROM entries WHERE category = 'en'), t AS (SELECT * FROM turns WHERE entry_id IN (SELECT id FROM e)) SELECT (SELECT count(*) FROM e) AS n_entries, coalesce((SELECT max(id) FROM e), 0) AS max_entry, count(*) AS n_turns, coalesce(max(entry_id), 0) AS max_turn_entry, count(DISTINCT entry_id) AS n_done, CAST(coalesce(max(entry_id), 0) >= coalesce((SELECT max(id) FROM e), 0) AS INTEGER) AS complete FROM t")
def rebuild_state_scope(spark, sf_dir):
    return St.rebuild_state(entries(spark, sf_dir), turns(spark, sf_dir), category="en")


def _one_line(spark, sf_dir):
    """Entries whose content is one phrase."""
    return entries(spark, sf_dir).withColumn("content", pick(PHRASES, F.col("id")))


_LINES = f"l AS (SELECT id, ({list(PHRASES)})[CAST(id % {len(PHRASES)} AS INTEGER) + 1] AS line FROM entries)"


@query("browse_dialogues_or_entries", f"WITH {turns_sql()}, {_LINES}, a AS (SELECT entry_id AS id, turn_index, speaker_label || ':' || turn_text AS x FROM turns UNION ALL SELECT id, 1, ':' || line FROM l WHERE id NOT IN (SELECT entry_id FROM turns)) SELECT 'entry:' || id AS conversation_key, count(*) AS turn_count, string_agg(x, chr(10) ORDER BY turn_index) AS body FROM a WHERE id IN (SELECT id FROM entries) GROUP BY id")
def browse_dialogues_or_entries(spark, sf_dir):
    d = St.dialogues_or_entries(_one_line(spark, sf_dir), turns(spark, sf_dir), P.split_entries)
    return d.select("conversation_key", F.col("turn_count").cast("long").alias("turn_count"), F.array_join(F.transform("turns", lambda t: F.concat(t["speaker_label"], F.lit(":"), t["turn_text"])), "\n").alias("body"))


@query("rebuild_turns", f"WITH {turns_sql()}, {_LINES} SELECT entry_id, turn_index, turn_text FROM turns WHERE category <> 'en' UNION ALL SELECT l.id, 1, line FROM l JOIN entries e ON e.id = l.id WHERE category = 'en'")
def rebuild_turns(spark, sf_dir):
    e = _one_line(spark, sf_dir)
    return I.rebuild(e, turns(spark, sf_dir).select("entry_id", "turn_index", "turn_text"), St.raw_scope(e, category="en"), P.split_entries)


@query("browse_page", f"WITH {ENTRIES_SQL} SELECT id, title, (SELECT count(*) FROM entries WHERE dataset_name = 'src1-en') AS total FROM entries WHERE dataset_name = 'src1-en' ORDER BY id DESC LIMIT 5 OFFSET 5")
def browse_page(spark, sf_dir):
    rows, about = St.browse_page(entries(spark, sf_dir), " 2 ", 5, dataset="src1-en")
    return rows.select("id", "title", F.lit(about["total"]).cast("long").alias("total"))


@query("category_order", f"WITH {ENTRIES_SQL}, c AS (SELECT DISTINCT {_SECTION} AS section, category FROM entries) SELECT section, category, CASE WHEN section = '{L.ANCIENT}' THEN list_position({list(L.ANCIENT_CATEGORIES)}, category) WHEN section = '{L.TEXT_DIALOGUE}' THEN list_position({[*L.ANCIENT_CATEGORIES, *L.MODERN_CATEGORIES]}, category) ELSE 7 END AS place FROM c")
def category_order(spark, sf_dir):
    c = entries(spark, sf_dir).select(St.section_column().alias("section"), "category").distinct()
    return c.select("*", St.category_rank(F.col("section"), F.col("category")).cast("int").alias("place"))


@query("catalog_columns", "SELECT 'turns' AS table_name, unnest(['id','entry_id','turn_index','speaker_label','turn_text','source','category','dataset_name','conversation_key']) AS column_name, unnest(range(1, 10)) AS place UNION ALL SELECT 'documents', column_name, ordinal_position FROM information_schema.columns WHERE table_name = 'documents'")
def catalog_columns(spark, sf_dir):
    c = columns_of({"turns": turns(spark, sf_dir), "documents": table(spark, sf_dir, "documents")})
    return c.withColumn("place", F.col("place").cast("long"))


@query("stored_tables", f"WITH {turns_sql()} SELECT t AS table_name, CASE t WHEN 'entries' THEN (SELECT count(*) FROM entries) WHEN 'turns' THEN (SELECT count(*) FROM turns) ELSE 0 END AS n FROM (SELECT unnest({sorted(SCHEMAS)}) AS t)")
def stored_tables(spark, sf_dir):
    """The rows of all tables after they were made and two of them filled."""
    folder = working_folder(spark, "tables")
    create_tables(spark, folder)
    for name, df in (("entries", entries(spark, sf_dir)), ("turns", turns(spark, sf_dir))):
        conform(df, SCHEMAS[name]).write.mode("append").parquet(f"{folder}/{name}")
    out = None
    for name, schema in sorted(SCHEMAS.items()):
        one = spark.read.schema(schema).parquet(f"{folder}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("table_facts", "SELECT 'documents' AS table_name, count(*) AS n_rows, 5 AS n_columns FROM documents UNION ALL SELECT 'conversations', count(*), 4 FROM conversations UNION ALL SELECT 'events', count(*), 6 FROM events")
def facts_of_tables(spark, sf_dir):
    """Rows and columns of the stored tables (their files are as many as the store has)."""
    return table_facts({n: table(spark, sf_dir, n) for n in ("documents", "conversations", "events")}).drop("n_files")


@query("conformed_entries", f"WITH {ENTRIES_SQL} SELECT id, title, CAST(year AS INTEGER) AS year, CAST(NULL AS VARCHAR) AS license_note, 'text' AS content FROM entries")
def conformed_entries(spark, sf_dir):
    """Rows of an older layout, without a column and with another type, in the layout of today."""
    old = entries(spark, sf_dir).select("id", "title", F.col("year").cast("string").alias("year"), F.lit("text").alias("content"), F.lit(1).alias("further"))
    return conform(old, SCHEMAS["entries"]).select("id", "title", "year", "license_note", "content")


@query("plan_facts", "SELECT 2 AS scans, 0 AS python_steps, true AS pushed")
def plan_of_a_search(spark, sf_dir):
    """What the plan of a search over turns with a filter on entries does: two scans, no Python, filters in the scans."""
    facts = plan_facts(turn_hits(turns(spark, sf_dir), entries(spark, sf_dir).where("id > 10"), SearchFilters("tion", year_from=2005)).select("id", "title"))
    return spark.createDataFrame([(facts["scans"] - 1, facts["python_steps"], facts["pushed"] > 0)], "scans int, python_steps int, pushed boolean")


@query("origin_labels", f"WITH {ENTRIES_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN crawl_source WHEN id % 3 = 1 THEN dataset_name ELSE category END AS origin FROM entries")
def origin_labels(spark, sf_dir):
    only = lambda c, k: F.when(F.col("id") % 3 <= k, F.col(c)).otherwise("")
    return entries(spark, sf_dir).select("id", origin_label(only("crawl_source", 0), only("dataset_name", 1), F.col("category")).alias("origin"))


@query("lookups", f"WITH {turns_sql()}, s AS (SELECT source, count(*) AS n FROM entries GROUP BY 1) SELECT 'stat' AS kind, CAST(n AS VARCHAR) AS found FROM s WHERE source = '{L.TEXT_DIALOGUE}' UNION ALL SELECT 'turn', turn_text FROM turns WHERE id = 1000002 UNION ALL SELECT 'entry', title FROM entries WHERE id = 5 UNION ALL SELECT 'there', 'true' UNION ALL SELECT 'missing', 'false'")
def lookups(spark, sf_dir):
    e = entries(spark, sf_dir)
    stats = St.counts_by(e, "source").select(F.col("source").alias("stat_key"), F.col("n").cast("string").alias("found"))
    rows = lookup(stats, L.TEXT_DIALOGUE, "stat_key").select(F.lit("stat").alias("kind"), "found")
    rows = rows.unionByName(lookup(turns(spark, sf_dir), 1_000_002).select(F.lit("turn").alias("kind"), F.col("turn_text").alias("found")))
    rows = rows.unionByName(lookup(e, 5).select(F.lit("entry").alias("kind"), F.col("title").alias("found")))
    return rows.unionByName(spark.createDataFrame([(k, str(exists(e, i)).lower()) for k, i in (("there", 5), ("missing", -1))], "kind string, found string"))


@query("resource_links", f"WITH {ENTRIES_SQL} SELECT count(*) AS n, count(*) FILTER (crawl_source = 'src0') AS from_first, max(CASE WHEN audio_file LIKE 'audio/%' THEN 'https://files/' || audio_file END) AS last_audio FROM entries")
def resource_links(spark, sf_dir):
    return entries(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("crawl_source") == "src0").alias("from_first"), F.max(audio_url(F.col("audio_file"))).alias("last_audio"))


@query("audio_plan", f"WITH {ENTRIES_SQL} SELECT DISTINCT audio_file, id % 20 = 0 AS uploaded FROM entries WHERE trim(audio_file) <> ''")
def audio_plan(spark, sf_dir):
    e = entries(spark, sf_dir)
    return R.audio_plan(e, e.where("id % 20 = 0 AND audio_file IS NOT NULL"))


@query("browse_keyword", f"WITH {ENTRIES_SQL} SELECT id, title FROM entries WHERE title ILIKE '%7%' OR content ILIKE '%7%'")
def browse_keyword(spark, sf_dir):
    return entries(spark, sf_dir).where(ilike(F.col("title"), "7") | ilike(F.col("content"), "7")).select("id", "title")
