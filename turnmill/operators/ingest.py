"""Ingestion, deduplication, back-fills, copies between stores, submissions; and interviews."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows
from ..functions.text import blank, clean_text, content_hash, filled, normalize_turn, parse_year, search_text, segment_hash, strip
from ..shipping import Working
from .tables import ENTRIES, SUBMISSIONS, conform

REQUIRED = ("title", "content", "source")
METADATA = ("source_url", "crawl_source", "crawl_date", "license_note")


def prepare(rows: DataFrame, batch: str, created_at: str) -> DataFrame:
    """Raw rows as entries, with `failed` where a required cell is blank. Missing optional columns count as blank."""
    cell = lambda n: strip(F.coalesce(F.col(n), F.lit(""))) if n in rows.columns else F.lit("")
    e = rows.select(*[cell(n).alias(n) for n in (*REQUIRED, "category", *METADATA)], parse_year(cell("year")).alias("year"), F.coalesce(filled(cell("dataset_name")), filled(cell("category")), cell("source")).alias("dataset_name"), *([F.col("row_no")] if "row_no" in rows.columns else []))
    failed = (F.col("title") == "") | (F.col("content") == "") | (F.col("source") == "")
    return e.withColumns({"failed": failed, "content_hash": content_hash(F.col("content")), "search_text": search_text(F.col("title"), F.col("content")), "import_batch": F.lit(batch), "created_at": F.lit(created_at)})


def first_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of least order for each key; no two rows have the same order. Winners are aggregated without the other columns, which
    then join by the order alone, so that a key which is costly to make is made once."""
    return _of_orders(df, key, order, df.groupBy(key).agg(F.min(order).alias(order)))


def _of_orders(df: DataFrame, key: str, order: str, winners: DataFrame) -> DataFrame:
    return df.drop(key).join(winners, order).select(*df.columns)


def import_rows(prepared: DataFrame, stored: DataFrame, order: str = "row_no") -> DataFrame:
    """New entries: of equal contents the first, none that is stored already."""
    ok = prepared.where(~F.col("failed"))
    winners = ok.groupBy("content_hash").agg(F.min(order).alias(order)).join(stored.select("content_hash"), "content_hash", "left_anti")
    return _of_orders(ok, "content_hash", order, winners)


def import_plain(rows: DataFrame, batch: str, created_at: str, required: tuple[str, ...] = ("title", "content", "source", "year", "category")) -> DataFrame:
    """Every row that has no blank required cell, equal ones too; all columns have to be there."""
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(", ".join(missing))
    return conform(prepare(rows, batch, created_at).where("NOT failed"), ENTRIES)


def import_report(prepared: DataFrame, new: DataFrame) -> DataFrame:
    """One row: success, failed, duplicate."""
    a = prepared.agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("failed"))
    return a.join(new.agg(F.count(F.lit(1)).alias("success"))).select("success", "failed", (F.col("n") - F.col("failed") - F.col("success")).alias("duplicate"))  # one row each


def duplicates(df: DataFrame, text: str) -> DataFrame:
    h = content_hash(F.col(text))
    return df.groupBy(h.alias("content_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


def segments(rows: DataFrame) -> DataFrame:
    """Audio segments (audio_file, start, end, text): empty and backward ones dropped, numbered, with the texts before and after."""
    ok = rows.select("audio_file", "start", "end", clean_text(F.col("text")).alias("text")).where((F.col("text") != "") & (F.col("end") > F.col("start")))
    w = Window.partitionBy("audio_file").orderBy("start", "end", "text")
    return ok.select("*", F.row_number().over(w).alias("segment_index"), F.lag("text", 1, "").over(w).alias("prev_segment"), F.lead("text", 1, "").over(w).alias("next_segment"), segment_hash(F.col("audio_file"), F.col("start"), F.col("end"), F.col("text")).alias("content_hash"))


def new_rows(rows: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    """Rows of which no key is stored; a null key is never stored."""
    for k in keys:
        rows = rows.join(stored.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
    return rows


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """All rows of new, and those of old whose keys it has not."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def copy_table(source: DataFrame, target: DataFrame, keys: tuple[str, ...], conflict: str = "skip") -> tuple[DataFrame, DataFrame]:
    """The target after copying source rows into it, and a row of counts: n_read, n_inserted, n_updated, n_skipped.

    A source row conflicts if the target has one of its keys. `skip` leaves the target's row; `update` replaces the row of equal
    first key, while rows that meet others by a further key alone are skipped. Rows of the source have distinct keys."""
    columns = target.columns
    rows = source.select(*columns)
    new = new_rows(rows, target, *keys)
    again = rows.join(target.select(keys[0]), keys[0], "left_semi") if conflict == "update" else rows.where(F.lit(False))
    out = target.join(again.select(keys[0]), keys[0], "left_anti").unionByName(again).unionByName(new).select(*columns)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = n(rows, "n_read").join(n(new, "n_inserted")).join(n(again, "n_updated"))  # one row each
    return out, counts.withColumn("n_skipped", F.col("n_read") - F.col("n_inserted") - F.col("n_updated"))


def capped(rows: DataFrame, limit: int, *order: str) -> DataFrame:
    """The first rows in order, after equal contents have been dropped (the first stays)."""
    return first_of(rows.withColumns({"content_hash": content_hash(F.col("content")), "place": F.struct(*order)}), "content_hash", "place").orderBy("place").limit(limit).drop("place")


def read_registry(spark, registry: dict[str, str], chosen: tuple[str, ...], read) -> DataFrame:
    """Rows of the chosen sources of a registry (name to path), `origin` naming each. An unknown name raises KeyError."""
    if unknown := [c for c in chosen if c not in registry]:
        raise KeyError(", ".join(unknown))
    out = None
    for name in dict.fromkeys(chosen):
        one = read(spark, registry[name]).withColumn("origin", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def manual_entry(form: DataFrame, at: str) -> DataFrame:
    """Entries typed in by hand (title, content, source, year, category); blank required cells give none."""
    e = prepare(form.withColumn("dataset_name", F.lit("admin_manual")), "admin_manual", at)
    return conform(e.where("NOT failed"), ENTRIES)


def submit(form: DataFrame, at: str) -> DataFrame:
    """Submissions as they arrive: pending, stored locally unless they say where."""
    known = {f.name for f in SUBMISSIONS}
    s = form.withColumns({"status": F.lit("pending"), "created_at": F.lit(at)})
    return conform(storage_defaults(s).select(*[c for c in storage_defaults(s).columns if c in known]), SUBMISSIONS)


def storage_defaults(rows: DataFrame) -> DataFrame:
    """Rows of an older store: where files lie, if they have any."""
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    stored = have("stored_filename")
    return rows.withColumns({"storage_backend": F.coalesce(filled(have("storage_backend")), F.when(~blank(stored), F.lit("local"))), "object_key": F.coalesce(filled(have("object_key")), filled(stored))})


def edit_text(submissions: DataFrame, edits: DataFrame) -> DataFrame:
    """Texts of pending submissions after edits (id, text_content, at): the last of each counts."""
    e = edits.groupBy(F.col("id").alias("e_id")).agg(F.max_by(F.struct("text_content"), "at").alias("e"))
    s = submissions.join(e, F.col("id") == F.col("e_id"), "left")
    return s.withColumn("text_content", F.when((F.col("status") == "pending") & F.col("e").isNotNull(), F.col("e.text_content")).otherwise(F.col("text_content"))).drop("e_id", "e")


def delete_submissions(submissions: DataFrame, ids: DataFrame) -> DataFrame:
    return submissions.join(ids.select("id"), "id", "left_anti")


def list_submissions(submissions: DataFrame, status: str = "pending") -> DataFrame:
    """Newest first; `all` lists every status."""
    s = submissions if status == "all" else submissions.where(F.col("status") == status)
    return s.orderBy(F.desc("created_at"), F.desc("id"))


def rebuild(entries: DataFrame, derived: DataFrame, scope: Column, split) -> DataFrame:
    """Derived rows (with entry_id) after those of the entries in scope have been thrown away and made anew by `split`."""
    taken = entries.where(scope)
    return derived.join(taken.select(F.col("id").alias("entry_id")), "entry_id", "left_anti").unionByName(split(taken).select(*derived.columns))


def copy_progress(source: DataFrame, target: DataFrame) -> DataFrame:
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(source, "source_rows").join(n(target, "target_rows")).withColumn("remaining", F.greatest(F.col("source_rows") - F.col("target_rows"), F.lit(0)))


def backfill(entries: DataFrame, metadata: DataFrame, columns: tuple[str, ...], condition: Column) -> DataFrame:
    """Columns taken from metadata by content_hash where it has a value and the condition holds. Several rows of one hash give
    their last filled value by row_no."""
    last = metadata.groupBy(F.col("content_hash").alias("m_hash")).agg(*[F.max_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("row_no"))).alias(f"m_{c}") for c in columns])
    both = entries.join(last, F.col("content_hash") == F.col("m_hash"), "left")
    return both.withColumns({c: F.when(condition, F.coalesce(filled(F.col(f"m_{c}")), F.col(c))).otherwise(F.col(c)) for c in columns}).select(*entries.columns)


def defaults(entries: DataFrame, **values: Column) -> DataFrame:
    return entries.withColumns({c: F.when(blank(F.col(c)), v).otherwise(F.col(c)) for c, v in values.items()})


def stale_search_text(entries: DataFrame) -> DataFrame:
    now = F.concat_ws(" ", "title", "content")
    return entries.where(~F.col("search_text").eqNullSafe(now)).withColumn("search_text", now)


def with_ids(rows: DataFrame, start: int, *order: str) -> DataFrame:
    """Ids after `start` in a total order; of rows equal in it, that of least content hash comes first. Sorted partitions are written
    once with each row's place, then numbered by the sizes of those before, so that no task sees all rows."""
    spark = rows.sparkSession
    by = [*order, "tie"]
    tied = rows.withColumn("tie", F.xxhash64(*rows.columns)).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = Working(spark, "ids").table("placed", tied.withColumn("place", F.monotonically_increasing_id()))  # partition in the upper bits, place in it in the lower 33
    placed = placed.withColumns({"part": F.shiftright("place", 33), "k": F.col("place").bitwiseAND((1 << 33) - 1)})
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    return placed.join(F.broadcast(before), "part").withColumn("id", F.col("before") + F.col("k") + start + 1).select(*rows.columns, "id")


def route(submissions: DataFrame) -> DataFrame:
    """Pending submissions with where an approval puts them: text without a file, or any with text, into the corpus, others to multimodal."""
    text = ~blank(F.col("text_content"))
    plain = F.col("modality").isin("text", "txt") & (blank(F.col("stored_filename")) | text)
    return submissions.where("status = 'pending'").withColumn("target", F.when(plain, "corpus").otherwise("multimodal"))


def approve(submissions: DataFrame, approved: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """Entries of the corpus and multimodal entries that approving (id) makes."""
    r = route(submissions).join(approved.select("id"), "id", "left_semi")
    content = strip(F.coalesce("text_content", F.lit("")))
    text = r.where("target = 'corpus'").where(content != "")
    corpus = text.select("title", content.alias("content"), F.coalesce(filled(F.col("source")), F.col("category")).alias("source"), "category", F.lit("public_submission").alias("dataset_name"), F.lit("public_submission").alias("import_batch"), F.lit(at).alias("created_at"), content_hash(content).alias("content_hash"), search_text(F.col("title"), content).alias("search_text"))
    multimodal = r.where("target = 'multimodal'").dropDuplicates(["id"]).withColumnRenamed("id", "submission_id").withColumns({"storage_backend": F.coalesce("storage_backend", F.lit("local")), "object_key": F.coalesce("object_key", "stored_filename")})
    return conform(corpus, ENTRIES), multimodal


def decide(submissions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Status after decisions (id, status, at): the last one of each counts; only pending ones change."""
    d = decisions.groupBy(F.col("id").alias("d_id")).agg(F.max_by("status", "at").alias("d_status"))
    s = submissions.join(d, F.col("id") == F.col("d_id"), "left")
    return s.withColumn("status", F.when(F.col("status") == "pending", F.coalesce("d_status", "status")).otherwise(F.col("status"))).drop("d_id", "d_status")


def title_class(title: Column, category: Column, dataset: Column) -> Column:
    out = None
    for terms, name, key in windows.OFFICES:
        hit, value = title.rlike("|".join(terms)), F.struct(F.lit(name).alias("category"), F.lit(key).alias("dataset_name"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.struct(category.alias("category"), dataset.alias("dataset_name")))


#: Kinds of pieces that titles name behind the chapter.
PIECES = ("对话单元", "片段", "规则", "LLM", "合并大对话")


def chapter_of(title: Column) -> Column:
    """What stands between a work's name and the first kind of piece in titles like 《雷雨》第一幕 对话单元 3; empty in others."""
    whole = strip(F.coalesce(title, F.lit("")))
    close = F.locate("》", whole)
    rest = F.when(whole.startswith("《") & (close > 2), F.substr(whole, close + 1))
    # of the kinds that stand behind white space the first counts, and something has to stand before it
    places = [F.regexp_instr(F.substr(rest, F.lit(2)), F.lit(rf"\s{kind}")) for kind in PIECES]
    first = F.array_min(F.filter(F.array(*places), lambda i: i > 0))
    return F.coalesce(strip(F.substr(rest, F.lit(1), first)), F.lit(""))


def import_sources(sources: dict[str, DataFrame], stored: DataFrame, batch: str, created_at: str) -> tuple[DataFrame, DataFrame]:
    """New entries of several raw sources, the first source winning where contents are equal, and totals for each source."""
    made = None
    for k, (name, rows) in enumerate(sources.items()):
        one = prepare(rows, batch, created_at).withColumns({"origin": F.lit(name), "order": F.struct(F.lit(k).alias("k"), F.col("row_no").alias("row_no"))})
        made = one if made is None else made.unionByName(one, allowMissingColumns=True)
    new = import_rows(made, stored, "order")
    found = made.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("failed"))
    kept = new.groupBy("origin").agg(F.count(F.lit(1)).alias("success"))
    totals = found.join(kept, "origin", "left").select("origin", F.coalesce("success", F.lit(0)).alias("success"), "failed", (F.col("n") - F.col("failed") - F.coalesce("success", F.lit(0))).alias("duplicate"))
    return new.drop("order"), totals


def source_order(dataset: Column, title: Column) -> list[Column]:
    """Sort keys of articles: official sources in their order, others behind them, then titles."""
    at = F.array_position(F.array(*[F.lit(d) for d in windows.SOURCE_ORDER]), dataset)
    return [F.when(at == 0, 99).otherwise(at - 1), title]


def page_texts(pages: DataFrame) -> DataFrame:
    """title, year and text of each page (page_id, url, html)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [windows.page(h, u) for h, u in zip(f["html"], f["url"])]
            yield pd.DataFrame({"page_id": f["page_id"], "url": f["url"]} | {k: [x[k] for x in found] for k in ("title", "year", "text")})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, title string, year string, text string")


def page_utterances(texts: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, i, s, b) for p, t in zip(f["page_id"], f["text"]) for i, (s, b) in enumerate(windows.utterances(t))]
            yield pd.DataFrame(rows, columns=["page_id", "seq", "speaker", "body"])

    return texts.select("page_id", "text").mapInPandas(run, "page_id long, seq int, speaker string, body string")


def qa_candidates(said: DataFrame, least: int = 60, most: int = 1200) -> DataFrame:
    """Questions with the utterance after them (article, seq, speaker, body): asked by role or mark, answered by another."""
    w = Window.partitionBy("article").orderBy("seq")
    n = said.select("*", F.lead("speaker").over(w).alias("next_speaker"), F.lead("body").over(w).alias("next_body"))
    asked = F.col("speaker").rlike(windows.ASKS.pattern) | F.col("body").rlike("[？?]")
    content = F.concat(F.col("speaker"), F.lit("："), F.col("body"), F.lit("\n"), F.col("next_speaker"), F.lit("："), F.col("next_body"))
    q = n.where(F.col("next_speaker").isNotNull() & ~F.col("speaker").isin(*sorted(windows.PAGE_SPEAKERS)) & asked & (F.col("speaker") != F.col("next_speaker")))
    return q.select("article", "seq", content.alias("content")).where(F.length("content").between(least, most))


_ITEMS = "array<struct<speaker:string,content:string,date:string>>"


def embedded_utterances(scripts: DataFrame, name: str = "characters") -> DataFrame:
    """(page_id, seq, speaker, body) of the JSON array that a script (page_id, js) assigns to `name`, in the order of the items'
    dates; scripts without one, or with something else there, have none."""
    found = F.regexp_extract("js", rf"(?s){name}\s*[=:]\s*(\[.*\])", 1)
    items = F.array_sort(F.from_json(found, _ITEMS), lambda x, y: F.when(F.coalesce(x["date"], F.lit("")) < F.coalesce(y["date"], F.lit("")), -1).when(F.coalesce(x["date"], F.lit("")) > F.coalesce(y["date"], F.lit("")), 1).otherwise(0))
    plain = lambda c: normalize_turn(F.regexp_replace(c, "<[^>]*>", " "))
    said = F.filter(F.transform(items, lambda x: F.struct(normalize_turn(x["speaker"]).alias("speaker"), plain(x["content"]).alias("body"))), lambda x: (x["speaker"] != "") & (x["body"] != ""))
    return scripts.select("page_id", F.posexplode(said).alias("seq", "x")).select("page_id", "seq", "x.speaker", "x.body")


def page_links(pages: DataFrame, token: str = "", most: int = 20, host: str = "", title: str = "") -> DataFrame:
    """Distinct links of pages (page_id, href, label) whose address holds the token and, where given, whose host and label hold theirs;
    an address counts for the first page that has it, and a page gives its first ones."""
    anchor = "<a href=\"([^\"]+)\"[^>]*>([^<]*)</a>"
    hrefs, labels = (F.regexp_extract_all("html", F.lit(anchor), F.lit(k)) for k in (1, 2))
    links = pages.select("page_id", F.posexplode(F.arrays_zip(hrefs.alias("href"), labels.alias("label"))).alias("k", "x")).select("page_id", "k", "x.href", F.trim("x.label").alias("label"))
    links = links.where(F.col("href").contains(token) & F.col("label").contains(title))
    if host:
        links = links.where(F.coalesce(F.try_parse_url("href", F.lit("HOST")), F.lit("")).contains(host))
    first = links.groupBy("href").agg(F.min(F.struct("page_id", "k", "label")).alias("x")).select("href", "x.*")
    return first.withColumn("rn", F.row_number().over(Window.partitionBy("page_id").orderBy("k"))).where(F.col("rn") <= most).select("page_id", "href", "label")
