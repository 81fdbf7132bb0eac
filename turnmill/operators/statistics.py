"""Corpus statistics, filter options, and browsing of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import blank, conversation_key, display_source, filled
from .search import display_condition, ilike


def counts_by(df: DataFrame, *names: str) -> DataFrame:
    return df.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


def section_column() -> Column:
    return display_source(F.col("source"), F.col("category"))


def detail(entries: DataFrame, turns: DataFrame, *names: str) -> DataFrame:
    """Entries, conversations and turns of each group. Groups without turns have as many conversations as entries."""
    e = entries.groupBy(*names).agg(F.count(F.lit(1)).alias("n_entries"))
    t = turns.groupBy(*names).agg(F.count(F.lit(1)).alias("n_turns"), F.countDistinct("conversation_key").alias("n_conversations"))
    both = e.join(t, list(names), "full")
    n = lambda c: F.coalesce(c, F.lit(0))
    return both.select(*names, n("n_entries").alias("n_entries"), F.when(n("n_conversations") > 0, F.col("n_conversations")).otherwise(n("n_entries")).alias("n_conversations"), n("n_turns").alias("n_turns"))


def section_stats(entries: DataFrame, turns: DataFrame, sections: tuple[str, ...] = ()) -> DataFrame:
    """detail() of each section. 文本对话 also counts what 古代汉语 shows, so the sections overlap. Asked sections without rows have
    zeros."""
    both = lambda df: df.withColumn("section", F.explode(F.array_distinct(F.array("source", section_column()))))
    found = detail(both(entries), both(turns), "section")
    if not sections:
        return found
    asked = entries.sparkSession.createDataFrame([(s,) for s in sections], "section string")
    return asked.join(found, "section", "left").na.fill(0)


def category_stats(entries: DataFrame, turns: DataFrame, source: str = "") -> DataFrame:
    """detail() of each category, of one stored source where given, in the order of names."""
    only = lambda df: df.where(F.col("source") == source) if source else df
    return detail(only(entries), only(turns), "category").orderBy("category")


def dataset_stats(entries: DataFrame, turns: DataFrame) -> DataFrame:
    """detail() of each dataset and category, the datasets of most conversations first."""
    return detail(entries, turns, "dataset_name", "category").orderBy(F.desc("n_conversations"), "dataset_name", "category")


def raw_scope(df: DataFrame, source: str = "", category: str = "", dataset: str = "") -> Column:
    """Rows that a rebuild takes: by stored columns, not display sections."""
    out = F.lit(True)
    for column, value in (("source", source), ("category", category), ("dataset_name", dataset)):
        if value:
            out = out & (F.col(column) == value)
    return out


def section_rank(section: Column) -> Column:
    order = F.array(*[F.lit(s) for s in L.SECTION_ORDER])
    at = F.array_position(order, section)
    return F.when(at == 0, len(L.SECTION_ORDER) + 1).otherwise(at)


def category_rank(section: Column, category: Column) -> Column:
    """Place of a category in its section's own order; others come after these, by name."""
    order = lambda names: F.array_position(F.array(*[F.lit(n) for n in names]), category)
    at = F.when(section == L.ANCIENT, order(L.ANCIENT_CATEGORIES)).when(section == L.TEXT_DIALOGUE, order((*L.ANCIENT_CATEGORIES, *L.MODERN_CATEGORIES))).otherwise(0)
    return F.when(at == 0, len(L.ANCIENT_CATEGORIES) + len(L.MODERN_CATEGORIES) + 1).otherwise(at)


def filter_options(entries: DataFrame, datasets: int = 300) -> DataFrame:
    """(kind, value): distinct filled sources (with the section 古代汉语 where its rows exist), years, categories, datasets."""
    one = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.cast("string").alias("value"))
    own = [one("source", F.col("source")), one("source", F.nullif(section_column(), F.col("source"))), one("category", F.col("category")), one("year", F.col("year"))]
    listed = lambda *options: entries.select(F.explode(F.array(*options)).alias("o")).select("o.*").where(~blank(F.col("value"))).distinct()
    return listed(*own).unionByName(listed(one("dataset", F.col("dataset_name"))).orderBy("value").limit(datasets))


def source_categories(entries: DataFrame) -> DataFrame:
    """Each display source with its categories in order, and a row __all__ with all categories."""
    rows = entries.where(~blank(F.col("source")) & ~blank(F.col("category"))).select(section_column().alias("source"), "category")
    each = rows.select(F.explode(F.array("source", F.lit("__all__"))).alias("source"), "category").distinct()
    return each.groupBy("source").agg(F.sort_array(F.collect_list("category")).alias("categories"))


def rebuild_state(entries: DataFrame, turns: DataFrame, **scope: str) -> DataFrame:
    """Whether turns cover all entries (of a scope): counts, greatest ids, and the comparison of these."""
    if any(scope.values()):
        entries = entries.where(raw_scope(entries, **scope))
        turns = turns.join(entries.select(F.col("id").alias("entry_id")), "entry_id", "left_semi")
    t = turns.agg(F.count(F.lit(1)).alias("n_turns"), F.coalesce(F.max("entry_id"), F.lit(0)).alias("max_turn_entry"), F.countDistinct("entry_id").alias("n_done"))
    e = entries.agg(F.count(F.lit(1)).alias("n_entries"), F.coalesce(F.max("id"), F.lit(0)).alias("max_entry"))
    return e.join(t).withColumn("complete", (F.col("max_turn_entry") >= F.col("max_entry")).cast("int"))  # one row each


def latest_of_conversations(entries: DataFrame, source: str = "", category: str = "", dataset: str = "", keyword: str = "") -> DataFrame:
    """The entry of greatest id for each conversation among those that the browse filters let through."""
    keep = display_condition(source, category)
    if dataset:
        keep = keep & (F.col("dataset_name") == dataset)
    if keyword:
        keep = keep & (ilike(F.coalesce("title", F.lit("")), keyword) | ilike(F.coalesce("content", F.lit("")), keyword))
    own = F.col("conversation_id") if "conversation_id" in entries.columns else F.lit(None).cast("string")
    rows = entries.where(keep).withColumn("conversation_key", conversation_key(own, F.col("id")))
    # ids are aggregated without the texts, and only columns that are asked for are joined to them
    return rows.join(rows.groupBy("conversation_key").agg(F.max("id").alias("id")).select("id"), "id", "left_semi").select("conversation_key", *[c for c in rows.columns if c != "conversation_key"])


def dialogues(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """Conversations (conversation_key, title) with their turns in order."""
    t = turns.groupBy("conversation_key").agg(F.sort_array(F.collect_list(F.struct("turn_index", "id", "speaker_label", "turn_text"))).alias("turns"))
    return conversations.join(t, "conversation_key", "left").select("conversation_key", F.coalesce(filled(F.col("title")), filled(F.col("conversation_key")), F.lit("未命名对话")).alias("title"), F.coalesce(F.size("turns"), F.lit(0)).alias("turn_count"), "turns")


def dialogues_or_entries(entries: DataFrame, turns: DataFrame, split) -> DataFrame:
    """dialogues() of all entries; those without turns are split (a function from entries to turns) when they are shown."""
    columns = ["conversation_key", "turn_index", "id", "speaker_label", "turn_text"]
    without = entries.join(turns.select(F.col("entry_id").alias("id")), "id", "left_anti")
    conversations = entries.select(F.concat(F.lit("entry:"), "id").alias("conversation_key"), "title")
    return dialogues(conversations, turns.select(*columns).unionByName(split(without).select(*columns)))


def first_turns(turns: DataFrame) -> DataFrame:
    return turns.where(F.trim("turn_text") != "").groupBy("conversation_key").agg(F.min_by("turn_text", F.struct("turn_index", "id")).alias("first_text"))


def page_window(total: int, page: int, size: int, width: int = 10) -> dict[str, int]:
    """Pages in all, the page shown, its offset, and the first and last page of the row of page links."""
    pages = max(1, -(-total // size))
    page = min(max(1, page), pages)
    first = max(1, min(page - width // 2, pages - width + 1))
    return {"pages": pages, "page": page, "offset": (page - 1) * size, "first": first, "last": min(pages, first + width - 1)}


def page_number(value, most: int | None = None) -> int:
    """From a request: 1 where it is none or too small."""
    try:
        n = max(1, int(str(value).strip()))
    except ValueError:
        return 1
    return n if most is None else min(n, most)


def browse_page(entries: DataFrame, page=1, size=10, total: int | None = None, **filters) -> tuple[DataFrame, dict]:
    """A page of conversations, newest first, and its arithmetic. Without a total known one row more than the page is fetched to
    tell whether a next page is there; with a keyword the total is not counted."""
    size = max(1, min(int(size), 20))
    rows = latest_of_conversations(entries, **filters).orderBy(F.desc("id"))
    if total is None and not filters.get("keyword"):
        total = latest_of_conversations(entries, **filters).count()
    if total is not None:
        w = page_window(total, page_number(page), size)
        return rows.offset(w["offset"]).limit(size), w | {"total": total, "has_next": w["page"] < w["pages"]}
    n = page_number(page)
    got = rows.offset((n - 1) * size).limit(size + 1)
    return got.limit(size), {"page": n, "offset": (n - 1) * size, "has_next": got.count() > size}
