"""Keyword search over entries and turns: filters as Columns, sorts, pages, neighbours, counts."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import regexplan
from ..functions.text import display_source, filled, like_pattern

MODES = ("contains", "exact", "starts_with", "ends_with", "regex")
FIELDS = {"all": ("title", "content", "speaker", "current_segment", "segment_text"), "content": ("content",), "title": ("title",), "speaker": ("speaker",), "segment": ("current_segment", "segment_text")}
FTS_COLUMNS = ("title", "content", "current_segment", "prev_segment", "next_segment")
SORTS = ("id_desc", "id_asc", "year_desc", "year_asc", "title_asc", "start_time_asc")


@dataclass(frozen=True)
class SearchFilters:
    keyword: str = ""
    mode: str = "contains"
    field: str = "content"
    source: str = ""
    category: str = ""
    dataset_name: str = ""
    year: str | int | None = None
    year_from: str | int | None = None
    year_to: str | int | None = None
    content_min: str | int | None = None
    content_max: str | int | None = None
    has_audio: bool = False
    title: str = ""
    speaker: str = ""
    exclude: str = ""
    sort: str = "id_desc"

    def normalized(self) -> SearchFilters:
        """Unknown choices become the defaults; a plain keyword that looks like a regular expression is one."""
        out = replace(self, mode=self.mode if self.mode in MODES else "contains", field=self.field if self.field in FIELDS else "content", sort=self.sort if self.sort in SORTS else "id_desc")
        return replace(out, mode="regex") if out.mode == "contains" and regexplan.looks_like_regex(out.keyword) else out

    @classmethod
    def from_args(cls, args: dict[str, str]) -> SearchFilters:
        """From a request's arguments: known names only, stripped; has_audio is set by 1, true, on or yes."""
        known = {f.name: str(args[f.name] or "").strip() for f in fields(cls) if f.name in args}
        if "has_audio" in known:
            known["has_audio"] = known["has_audio"].lower() in ("1", "true", "on", "yes")
        return cls(**known).normalized()

    def countable(self) -> bool:
        """Whether an exact count is worth its scan: for two characters or more, or a pattern with a literal to look for first."""
        f = self.normalized()
        return bool(regexplan.prefilters(f.keyword) or regexplan.alternatives(f.keyword)) if f.mode == "regex" else len(f.keyword.strip()) > 1

    def advanced(self) -> bool:
        plain = SearchFilters(keyword=self.keyword, source=self.source, category=self.category)
        return any(getattr(self, f.name) != getattr(plain, f.name) for f in fields(self))


def whole_number(value) -> int | None:
    try:
        return int(str(value).strip())
    except ValueError:
        return None


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def ilike(column: Column, value: str, mode: str = "contains") -> Column:
    return column.ilike(like_pattern(value, mode))


def matches(column: Column, pattern: str) -> Column:
    """Unanchored, ignoring case. Literal alternatives replace the pattern; otherwise literals that each match contains stand
    before it, which are cheap to test."""
    if options := regexplan.alternatives(pattern):
        return _any([ilike(column, o) for o in options])
    out = column.rlike("(?iuU)" + regexplan.java(pattern))
    for literal in regexplan.prefilters(pattern):
        out = ilike(column, literal) & out
    return out


def text_condition(df: DataFrame, keyword: str, names: tuple[str, ...], mode: str) -> Column:
    if mode == "regex":
        if regexplan.error(keyword):
            return F.lit(False)
        return _any([matches(_text(df, n), keyword) for n in names])
    return _any([ilike(_text(df, n), keyword, mode) for n in names])


def display_condition(source: str, category: str, s: Column | None = None, c: Column | None = None) -> Column:
    """Sections that are views of a stored source: 古代汉语 has four of its categories, 文本对话 all six; others don't match."""
    s, c = F.col("source") if s is None else s, F.col("category") if c is None else c
    views = {L.ANCIENT: L.ANCIENT_CATEGORIES, L.TEXT_DIALOGUE: (*L.ANCIENT_CATEGORIES, *L.MODERN_CATEGORIES)}
    if source in views:
        if category and category not in views[source]:
            return F.lit(False)
        return (s == L.TEXT_DIALOGUE) & (c == category if category else c.isin(*views[source]))
    out = F.lit(True)
    if source:
        out = out & (s == source)
    if category:
        out = out & (c == category)
    return out


def _limits(df: DataFrame, f: SearchFilters, content: Column) -> Column:
    """What entry and turn searches share. Numbers that are none are ignored."""
    out = display_condition(f.source, f.category)
    for value, test in ((f.year, F.col("year").__eq__), (f.year_from, F.col("year").__ge__), (f.year_to, F.col("year").__le__), (f.content_min, F.length(content).__ge__), (f.content_max, F.length(content).__le__)):
        if value not in (None, "") and (n := whole_number(value)) is not None:
            out = out & test(n)
    if f.dataset_name:
        out = out & (F.col("dataset_name") == f.dataset_name)
    if f.has_audio:
        out = out & (F.trim("audio_file") != "")
    if f.title:
        out = out & ilike(_text(df, "title"), f.title)
    return out


def entry_condition(df: DataFrame, f: SearchFilters, joined: bool = False) -> Column:
    """joined: the field `all` is the one search_text, in which a keyword may reach over the border of two columns."""
    f = f.normalized()
    out = _limits(df, f, _text(df, "content"))
    if f.speaker:
        out = out & ilike(_text(df, "speaker"), f.speaker)
    if f.keyword:
        out = out & text_condition(df, f.keyword, ("search_text",) if joined and f.field == "all" else FIELDS[f.field], f.mode)
    if f.exclude:
        out = out & ~text_condition(df, f.exclude, ("search_text",) if joined else FIELDS["all"], "contains")
    return out


def fts_condition(df: DataFrame, keyword: str) -> Column:
    """A phrase in any indexed column, ignoring case; the trigram index answers from three characters on, below that a plain search."""
    return _any([ilike(_text(df, n), keyword) for n in FTS_COLUMNS])


def entry_order(sort: str, nulls_last: bool = False) -> list[Column]:
    year, start = F.col("year"), F.col("start_time")
    if sort == "id_asc":
        return [F.asc("id")]
    first = {
        "year_desc": year.desc_nulls_last() if nulls_last else year.desc(), "year_asc": year.asc_nulls_last() if nulls_last else year.asc(),
        "title_asc": F.coalesce("title", F.lit("")).asc() if nulls_last else F.asc("title"), "start_time_asc": start.asc_nulls_last() if nulls_last else start.asc(),
    }.get(sort)
    return [F.desc("id")] if first is None else [first, F.desc("id")]


def search_entries(entries: DataFrame, f: SearchFilters, limit: int | None = None, offset: int = 0) -> DataFrame:
    f = f.normalized()
    hits = entries.where(entry_condition(entries, f))
    if limit is None:
        return hits
    page = hits.orderBy(*entry_order(f.sort))
    return (page.offset(offset) if offset else page).limit(limit)


def filter_steps(entries: DataFrame, f: SearchFilters) -> DataFrame:
    """(place, step, rows_in, rows_removed): what each filter of a search removes, one after another, from one scan."""
    f = f.normalized()
    plain = SearchFilters()
    steps = [(n.name, replace(plain, **({n.name: getattr(f, n.name)} | ({"mode": f.mode, "field": f.field} if n.name == "keyword" else {})))) for n in fields(f) if n.name not in ("mode", "field", "sort") and getattr(f, n.name) != getattr(plain, n.name)]
    passed, counts = F.lit(True), [F.count(F.lit(1)).alias("n0")]
    for k, (_, one) in enumerate(steps, 1):
        passed = passed & F.coalesce(entry_condition(entries, one), F.lit(False))
        counts.append(F.count_if(passed).alias(f"n{k}"))
    rows = [F.struct(F.lit(k).alias("place"), F.lit(name).alias("step"), F.col(f"n{k - 1}").alias("rows_in"), (F.col(f"n{k - 1}") - F.col(f"n{k}")).alias("rows_removed")) for k, (name, _) in enumerate(steps, 1)]
    return entries.agg(*counts).select(F.explode(F.array(*rows)).alias("x")).select("x.*") if rows else entries.sparkSession.createDataFrame([], "place int, step string, rows_in long, rows_removed long")


def count_entries(entries: DataFrame, f: SearchFilters) -> DataFrame:
    return entries.where(entry_condition(entries, f)).agg(F.count(F.lit(1)).alias("n"))


def needs_entries(f: SearchFilters) -> bool:
    """Whether a turn search has to join entries: only for filters and sorts on their columns."""
    return bool(f.year or f.year_from or f.year_to or f.has_audio or f.title) or f.sort not in ("id_desc", "id_asc")


def turn_hits(turns: DataFrame, entries: DataFrame, f: SearchFilters) -> DataFrame:
    """Turns that match, with entry columns where the filters need them; none without a keyword."""
    f = f.normalized()
    if not f.keyword:
        return turns.where(F.lit(False))
    t = turns
    if needs_entries(f):
        t = t.join(entries.select(F.col("id").alias("entry_id"), "title", "year", "audio_file", *(["start_time"] if "start_time" in entries.columns else [])), "entry_id")
    out = text_condition(t, f.keyword, ("turn_text",), f.mode) & _limits(t, f, F.col("turn_text"))
    if f.speaker:
        out = out & ilike(F.col("speaker_label"), f.speaker)
    if f.exclude:
        out = out & ~ilike(F.col("turn_text"), f.exclude)
    return t.where(out)


def with_neighbours(hits: DataFrame, turns: DataFrame) -> DataFrame:
    """prev_text and next_text by (conversation_key, turn_index -1 / +1); of several the one of least id."""
    side = lambda step, name: turns.groupBy(F.col("conversation_key").alias("k"), (F.col("turn_index") + step).alias("i")).agg(F.min_by("turn_text", "id").alias(name))
    out = hits
    for step, name in ((1, "prev_text"), (-1, "next_text")):
        out = out.join(side(step, name), (F.col("conversation_key") == F.col("k")) & (F.col("turn_index") == F.col("i")), "left").drop("k", "i")
    return out.withColumns({n: F.coalesce(n, F.lit("")) for n in ("prev_text", "next_text")})


#: A page of so many rows at most goes through the driver; a larger one stays a plan.
PAGE_ROWS = 1000


def small_page(df: DataFrame, limit: int) -> DataFrame:
    """A page of `limit` rows at most as a local table. It is worked out once, however often it is used, and joins with it know its
    size; its keys can be pushed into scans as literals."""
    return df.sparkSession.createDataFrame(df.limit(limit).collect(), df.schema) if limit <= PAGE_ROWS else df.limit(limit)


def _among(df: DataFrame, column: str, page: DataFrame, key: str, limit: int) -> DataFrame:
    """The rows of df whose column is one of the page's keys."""
    if limit <= PAGE_ROWS:
        return df.where(F.col(column).isin([r[0] for r in page.select(key).distinct().collect()]))
    return df.join(page.select(F.col(key).alias(column)).distinct(), column, "left_semi")


def _of_conversations(turns: DataFrame, page: DataFrame, limit: int) -> DataFrame:
    """The turns of the page's conversations. One that is an entry's own has that entry's turns only, and its id reaches the scan."""
    if limit > PAGE_ROWS:
        return _among(turns, "conversation_key", page, "conversation_key", limit)
    keys = [(r[0], r[1]) for r in page.select("conversation_key", "entry_id").distinct().collect()]
    own = F.col("conversation_key").isin([k for k, _ in keys])
    if all(k == f"entry:{e}" for k, e in keys):
        own = F.col("entry_id").isin([e for _, e in keys]) & own
    return turns.where(own)


def search_turns(turns: DataFrame, entries: DataFrame, f: SearchFilters, limit: int, offset: int = 0) -> DataFrame:
    """A page of hits with neighbours and entry data. The page is cut before the joins, so these touch its rows only."""
    f = f.normalized()
    hits = turn_hits(turns, entries, f).orderBy(*entry_order(f.sort, nulls_last=True))
    page = small_page((hits.offset(offset) if offset else hits).select(*turns.columns), limit)
    beside = page.select("conversation_key", F.explode(F.array(F.col("turn_index") - 1, F.col("turn_index") + 1)).alias("turn_index")).distinct()
    near = _of_conversations(turns, page, limit).join(F.broadcast(beside) if limit <= PAGE_ROWS else beside, ["conversation_key", "turn_index"], "left_semi")
    near = near.groupBy("conversation_key", "turn_index").agg(F.min_by("turn_text", "id").alias("turn_text"), F.min("id").alias("id"))
    rows = with_neighbours(page, small_page(near, 2 * limit) if limit <= PAGE_ROWS else near)
    e = _among(entries, "id", page, "entry_id", limit).select(F.col("id").alias("e_id"), "title", "year", F.col("source").alias("e_source"), F.col("category").alias("e_category"), F.col("dataset_name").alias("e_dataset"))
    rows = rows.join(e, F.col("entry_id") == F.col("e_id"), "left")
    own = lambda a, b: F.coalesce(filled(F.col(a)), F.col(b), F.lit(""))
    return rows.select("id", "entry_id", "conversation_key", "turn_index", "speaker_label", "prev_text", F.col("turn_text").alias("hit_text"), "next_text", F.coalesce("title", F.lit("")).alias("title"), "year", display_source(own("e_source", "source"), own("e_category", "category")).alias("source"), own("e_category", "category").alias("category"), own("e_dataset", "dataset_name").alias("dataset_name"))


def first_of_conversations(hits: DataFrame) -> DataFrame:
    """Conversations in the order of their first hit (the greatest id)."""
    return hits.groupBy("conversation_key").agg(F.max("id").alias("first_hit"), F.count(F.lit(1)).alias("n_hits"))


def kwic(df: DataFrame, text: str, keyword: str, left: int = 30, right: int = 30) -> DataFrame:
    """left_context, hit and right_context around the first place where the keyword stands, case and all; without one the text's
    beginning and what follows."""
    at = F.locate(keyword, F.col(text))
    n = len(keyword)
    start = F.greatest(at - left, F.lit(1))
    t = F.col(text)
    return df.withColumns({
        "left_context": F.when(at > 0, F.substr(t, start, at - start)).otherwise(F.substring(t, 1, left)),
        "hit": F.when(at > 0, F.lit(keyword)).otherwise(F.lit("")),
        "right_context": F.when(at > 0, F.substr(t, at + n, F.lit(right))).otherwise(F.substr(t, F.lit(left + 1), F.lit(right))),
    })


def kwic_regex(df: DataFrame, text: str, pattern: str, left: int = 30, right: int = 30) -> DataFrame:
    """The same around the first match of a pattern, in any case; rows without one, and all rows for a pattern that is refused, have
    no hit."""
    t, p = F.col(text), F.lit("(?iuU)" + regexplan.java(pattern))
    at = F.lit(0) if regexplan.error(pattern) else F.regexp_instr(t, p)
    hit = F.when(at > 0, F.regexp_extract(t, "(?iuU)" + regexplan.java(pattern), 0)).otherwise("") if not regexplan.error(pattern) else F.lit("")
    start = F.greatest(at - left, F.lit(1))
    return df.withColumns({
        "left_context": F.when(at > 0, F.substr(t, start, at - start)).otherwise(F.substring(t, 1, left)),
        "hit": hit,
        "right_context": F.when(at > 0, F.substr(t, at + F.length(hit), F.lit(right))).otherwise(F.substr(t, F.lit(left + 1), F.lit(right))),
    })


def match_counts(turns: DataFrame, keyword: str) -> DataFrame:
    """Turns of each conversation that contain the keyword."""
    return turns.groupBy("conversation_key").agg(F.count_if(ilike(F.col("turn_text"), keyword)).alias("n_hits"), F.count(F.lit(1)).alias("n_turns")).where("n_hits > 0")


def candidate_limit(value, default: int = 300, most: int = 1000) -> int:
    try:
        return max(1, min(int(value), most))
    except (TypeError, ValueError):
        return default


def candidate_turns(turns: DataFrame, keyword: str, limit=300, source: str = "", category: str = "", before_id: int | None = None) -> DataFrame:
    """The newest turns with the keyword in a display section, below an id where one is given."""
    keep = ilike(F.col("turn_text"), keyword) & display_condition(source, category)
    if before_id is not None:
        keep = keep & (F.col("id") < before_id)
    return turns.where(keep).orderBy(F.desc("id")).limit(candidate_limit(limit))


def candidate_pairs(turns: DataFrame, keyword: str, limit=300, **where) -> DataFrame:
    """Candidate turns, each with the turn before and the one after; every pair once."""
    n = candidate_limit(limit)
    hit = small_page(candidate_turns(turns, keyword, n, **where).select("id", "conversation_key", "entry_id"), n)
    near = _of_conversations(turns, hit, n)
    a, b = (near.select("conversation_key", F.col("turn_index").alias(f"index_{x}"), F.col("id").alias(f"turn_{x}_id"), F.col("turn_text").alias(f"text_{x}")) for x in "ab")
    pairs = a.join(b.withColumn("index_a", F.col("index_b") - 1), ["conversation_key", "index_a"])
    for side in "ab":  # two joins by a key, where an OR of both would compare all rows
        pairs = pairs.join(F.broadcast(hit.select(F.col("id").alias(f"turn_{side}_id"), F.lit(True).alias(f"hit_{side}"))), f"turn_{side}_id", "left")
    return pairs.where("hit_a OR hit_b").drop("hit_a", "hit_b")


def page_of_turns(turns: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of all turns in the order that conversations have them."""
    return turns.orderBy("conversation_key", "turn_index", "id").offset(offset).limit(limit)


def lookup(df: DataFrame, value, key: str = "id") -> DataFrame:
    """The row of a key, one at most."""
    return df.where(F.col(key) == value).limit(1)


def exists(df: DataFrame, value, key: str = "id") -> bool:
    return not lookup(df, value, key).isEmpty()


def newest_in_order(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(F.desc("id")).limit(limit)


def ranked(df: DataFrame, by: list[Column], partition: list[str]) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*partition).orderBy(*by)))
