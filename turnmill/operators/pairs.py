"""Turns from entries, pairs of adjacent turns with resonance features, retrieval of pairs, and their grids."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import diagraph, grammar, phrases, relation_model
from ..functions import lexicon as L
from ..functions.text import contains_any, conversation_key, display_source, fragment_label, frames_in_both, markers_in, normalize_speaker, normalize_turn, origin_label
from .search import display_condition, ilike
from .tables import turn_id

_PAIR = T.ArrayType(T.StructType([T.StructField("speaker", T.StringType()), T.StructField("text", T.StringType())]))
FEATURES = T.StructType([T.StructField("shared_terms", T.ArrayType(T.StringType())), T.StructField("markers", T.ArrayType(T.StringType())), *[T.StructField(f, T.IntegerType()) for f in L.FLAGS.values()]])


@F.pandas_udf(_PAIR)
def _content_turns(content: pd.Series) -> pd.Series:
    return content.map(lambda x: [{"speaker": s, "text": t} for s, t in grammar.split_content(x)])


@F.pandas_udf(FEATURES)
def pair_features(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    known: dict[tuple, dict] = {}
    for pair in zip(a, b, strict=True):
        if pair not in known:
            known[pair] = phrases.features(*pair)
    return pd.DataFrame([known[pair] for pair in zip(a, b, strict=True)], columns=FEATURES.names)


@F.pandas_udf(T.ArrayType(T.StringType()))
def shared_phrases(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple, list[str]] = {}
    for pair in zip(a, b, strict=True):
        if pair not in known:
            known[pair] = phrases.shared(*pair)
    return pd.Series([known[pair] for pair in zip(a, b, strict=True)])


def split_entries(entries: DataFrame) -> DataFrame:
    """Turns of entries (id, content, and where present current_segment, segment_text, speaker, conversation_id, segment_index).
    An entry with a segment is one turn, found by JVM functions; others are split by the grammar, in Arrow batches."""
    have = lambda n: F.col(n) if n in entries.columns else F.lit(None).cast("string")
    segment = normalize_turn(F.coalesce(F.nullif(have("current_segment"), F.lit("")), have("segment_text")))
    keep = [n for n in ("source", "category", "dataset_name") if n in entries.columns]
    e = entries.withColumn("segment", segment)
    one = normalize_speaker(have("speaker"), F.col("segment"))
    index = F.when(have("segment_index").cast("string").rlike("^[0-9]+$") & (have("segment_index").cast("int") != 0), have("segment_index").cast("int")).otherwise(1)
    whole = e.where("segment <> ''").select(F.col("id").alias("entry_id"), index.alias("turn_index"), one["speaker"].alias("speaker_label"), one["text"].alias("turn_text"), conversation_key(have("conversation_id"), F.col("id")).alias("conversation_key"), *keep)
    parts = e.where("segment = ''").select(F.col("id").alias("entry_id"), F.posexplode(_content_turns(F.coalesce("content", F.lit("")))).alias("k", "t"), *keep)
    parts = parts.select("entry_id", (F.col("k") + 1).alias("turn_index"), F.col("t.speaker").alias("speaker_label"), F.col("t.text").alias("turn_text"), F.concat(F.lit("entry:"), F.col("entry_id")).alias("conversation_key"), *keep)
    return whole.unionByName(parts).select(turn_id(F.col("entry_id"), F.col("turn_index")).alias("id"), "*")


def adjacent_pairs(turns: DataFrame) -> DataFrame:
    """Each turn with its successor in the conversation, where their indexes follow each other."""
    w = Window.partitionBy("conversation_key").orderBy("turn_index", "id")
    before = F.lag(F.struct("id", "turn_index", "speaker_label", "turn_text")).over(w)
    p = turns.withColumn("a", before).where("turn_index = a.turn_index + 1")
    return p.select(
        F.col("id").alias("id"), F.col("a.id").alias("turn_a_id"), F.col("id").alias("turn_b_id"), "entry_id", "conversation_key", F.col("a.turn_index").alias("turn_index_a"), F.col("turn_index").alias("turn_index_b"),
        F.coalesce("a.speaker_label", F.lit("")).alias("speaker_a"), F.coalesce("speaker_label", F.lit("")).alias("speaker_b"), F.col("a.turn_text").alias("text_a"), F.col("turn_text").alias("text_b"), "source", "category", "dataset_name",
    )


def with_features(pairs: DataFrame) -> DataFrame:
    """shared_terms, markers and flags. Equal pairs of texts, which are common in dialogue, are worked out once for each batch of
    the UDF; the rest stays in the JVM."""
    return pairs.withColumn("f", pair_features("text_a", "text_b")).select("*", "f.*").drop("f")


def question_answer(a: Column, b: Column) -> Column:
    return contains_any(a, L.QUESTION_MARKERS) & (contains_any(b, L.RESPONSE_MARKERS) | (F.length(b) >= 8))


def contrast(b: Column) -> Column:
    return F.slice(markers_in(b, L.CONTRAST_MARKERS), 1, 4)


def frames(a: Column, b: Column) -> Column:
    return F.slice(frames_in_both(a, b), 1, 4)


def explanation(preset: str, a: Column | str = "text_a", b: Column | str = "text_b", shared: Column | str = "shared_terms") -> Column:
    """Struct of terms and explanation for a pair that shows the preset, else null. shared: the pair's shared phrases."""
    a, b, shared = (F.col(x) if isinstance(x, str) else x for x in (a, b, shared))
    found = lambda terms, *text: F.struct(terms.alias("terms"), F.concat(*text).alias("explanation"))
    listed = lambda head, terms: found(terms, F.lit(head), F.array_join(terms, " / "))
    first = lambda c, n: F.slice(c, 1, n)
    framed, revised, contrasted = frames(a, b), first(markers_in(b, L.REVISION_MARKERS), 3), contrast(b)
    kinds = {
        "lexical_echo": F.when(F.size(shared) > 0, listed(L.SHARES, first(shared, 5))),
        "pattern_reuse": F.when(F.size(framed) > 0, listed(L.REUSES, framed)).when(F.size(shared) > 1, listed(L.RECURS, first(shared, 4))),
        "qa_response": F.when(question_answer(a, b), found(first(markers_in(a, L.QUESTION_MARKERS), 3), F.lit(L.ANSWERS))),
        "contrast_response": F.when(F.size(contrasted) > 0, listed(L.CONTRASTS, contrasted)),
        "repair_revision": F.when((F.size(shared) > 0) & (F.size(revised) > 0), found(F.array_distinct(F.concat(first(shared, 3), revised)), F.lit(L.REPAIRS))),
    }
    named = {"reproduction": "lexical_echo", "parallel": "pattern_reuse", "selection": "repair_revision", "contrast": "contrast_response"}
    if preset == "analogy":
        return F.lit(None).cast("struct<terms:array<string>,explanation:string>")
    if preset in kinds or preset in named:
        return kinds[named.get(preset, preset)]
    return F.coalesce(*[kinds[k] for k in ("lexical_echo", "pattern_reuse", "qa_response", "repair_revision")])


def flag_totals(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), *[F.sum(f).alias(f) for f in L.FLAGS.values()])


def page_size(value, default: int = 20, most: int = 50) -> int:
    try:
        return max(1, min(int(value), most))
    except (TypeError, ValueError):
        return default


def resonance_condition(preset: str, keyword: str = "", cursor: int | None = None, source: str = "", category: str = "") -> Column:
    preset = L.ALIASES.get(preset, preset if preset in L.PRESET_FLAGS else "resonance")
    out = F.lit(False)
    for flag in L.PRESET_FLAGS[preset]:
        out = out | (F.col(flag) == 1)
    if cursor is not None:
        out = out & (F.col("id") < cursor)
    if len(keyword.strip()) == 1:
        return F.lit(False)  # one character would match nearly everything
    if keyword:
        out = out & (ilike(F.col("text_a"), keyword) | ilike(F.col("text_b"), keyword))
    return out & display_condition(source, category)


def resonance_page(pairs: DataFrame, preset: str = "resonance", limit=20, **where) -> DataFrame:
    """Newest pairs that show the preset."""
    return pairs.where(resonance_condition(preset, **where)).orderBy(F.desc("id")).limit(page_size(limit))


def resonance_scan(pairs: DataFrame, preset: str = "resonance", limit=20, **where) -> DataFrame:
    """A page of newest pairs that show the preset, with terms and explanation, has_next and next_cursor (the id below which
    the next page begins, null at the end).

    More pairs than the page has are fetched, since flags may be older than the rules that explain a pair: the page ends
    with the last one explained, and the cursor is the last id looked at."""
    n = page_size(limit)
    fetch = min(max(n + 1, 8 * n + 1), 200)
    got = pairs.where(resonance_condition(preset, **where)).orderBy(F.desc("id")).limit(fetch).withColumn("x", explanation(preset))
    order = Window.orderBy(F.desc("id"))  # `fetch` rows
    got = got.withColumns({"k": F.count("x").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "fetched": F.count(F.lit(1)).over(Window.partitionBy()), "at": F.row_number().over(order)})
    scanned = got.where((F.col("k") < n) | (F.col("k") == n) & F.col("x").isNotNull())
    all_ = Window.partitionBy()
    scanned = scanned.withColumns({"last": F.min("id").over(all_), "n_scanned": F.max("at").over(all_)})
    more = (F.col("fetched") > F.col("n_scanned")) | (F.col("fetched") == fetch)
    return scanned.where("x IS NOT NULL").select(*pairs.columns, "x.terms", "x.explanation", more.alias("has_next"), F.when(more, F.col("last")).alias("next_cursor"))


def with_entries(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs as a results page shows them: with their entry's title, year and origin, and the display section."""
    e = entries.select(F.col("id").alias("e_id"), F.coalesce("title", F.lit("")).alias("entry_title"), "year", F.col("crawl_source").alias("e_crawl"), F.coalesce("audio_file", F.lit("")).alias("audio_file"))
    p = pairs.join(e, F.col("entry_id") == F.col("e_id"), "left")
    label = fragment_label(F.col("conversation_key"), F.col("turn_index_a"), F.col("turn_index_b"))
    return p.withColumns({"entry_title": F.coalesce("entry_title", F.lit("")), "section": display_source(F.col("source"), F.col("category")), "origin": origin_label(F.col("e_crawl"), F.col("dataset_name"), F.col("category")), "fragment": label}).drop("e_id", "e_crawl")


def showcase_page(pairs: DataFrame, datasets: tuple[str, ...], preset: str = "resonance", limit=20) -> DataFrame:
    """Short pairs of different speakers from a few datasets, one of each dataset in turn, newest first."""
    a, b = F.length("text_a"), F.length("text_b")
    speakers = (F.trim("speaker_a") == "") | (F.trim("speaker_b") == "") | (F.trim("speaker_a") != F.trim("speaker_b"))
    fit = pairs.where(resonance_condition(preset) & F.col("dataset_name").isin(*datasets) & a.between(4, 60) & b.between(2, 90) & (a + b <= 120) & speakers)
    size = page_size(limit)
    place = F.array_position(F.array(*[F.lit(d) for d in datasets]), F.col("dataset_name"))
    turn = fit.withColumn("turn", F.row_number().over(Window.partitionBy("dataset_name").orderBy(F.desc("id")))).where(F.col("turn") <= size)
    return turn.orderBy("turn", place, F.desc("id")).limit(size)


def window_turns(pairs: DataFrame, turns: DataFrame, window: str = "pair") -> DataFrame:
    """The turns around each pair (id, conversation_key, turn_index_a, turn_index_b): its two, some more on each side, or all. The
    places of a window are listed and joined by conversation and place, so a long conversation is not paired with itself."""
    more = {"context2": 2, "context5": 5}.get(window, 0)
    p = pairs.select(F.col("id").alias("pair_id"), "conversation_key", "turn_index_a", "turn_index_b")
    on = ["conversation_key"]
    if window != "full":
        p = p.select("pair_id", "conversation_key", F.explode(F.sequence(F.col("turn_index_a") - more, F.col("turn_index_b") + more)).alias("turn_index"))
        on.append("turn_index")
    return p.join(turns.select("conversation_key", "turn_index", "id", "speaker_label", "turn_text"), on).select("pair_id", "turn_index", "id", "speaker_label", "turn_text")


def pairs_with_windows(turns: DataFrame, window: str = "pair") -> DataFrame:
    """The turns around each pair of adjacent turns, as adjacent_pairs() and window_turns() give them, from one sorted pass over
    conversations. Turns stored by conversation (layout.py) are not shuffled for it."""
    more = {"context2": 2, "context5": 5}.get(window, 0)
    by = Window.partitionBy("conversation_key").orderBy("turn_index")
    near = by.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing) if window == "full" else by.rangeBetween(-(more + 1), more)
    told = F.collect_list(F.struct("turn_index", "id", "speaker_label", "turn_text")).over(near)
    before = F.lag("turn_index").over(Window.partitionBy("conversation_key").orderBy("turn_index", "id"))
    found = turns.withColumns({"before": before, "near": told}).where("turn_index = before + 1").select(F.col("id").alias("pair_id"), F.explode("near").alias("x"))
    return found.select("pair_id", "x.turn_index", "x.id", "x.speaker_label", "x.turn_text")


_GRID = "pair_id long, row_no int, speaker string, cells map<string,string>"
_RELATIONS = "pair_id long, place int, column string, mapping string, relation string, mechanisms array<string>"


def _grids(frames_: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for frame in frames_:
        for r in frame.itertuples(index=False):
            rows = sorted((t["turn_index"], t["id"], t["speaker_label"] or "未标注", t["turn_text"] or "") for t in r.turns)
            yield r.pair_id, rows, diagraph.Grid([t[3] for t in rows], phrases.merged(list(r.terms)))


def _grid_rows(it):
    for pair, rows, grid in _grids(it):
        yield pd.DataFrame([(pair, t[0], t[2], c) for t, c in zip(rows, grid.named_cells(), strict=True)], columns=["pair_id", "row_no", "speaker", "cells"])


def _relation_rows(it):
    for pair, _, grid in _grids(it):
        found = grid.relations()
        yield pd.DataFrame([(pair, k, r["column"], r["mapping"], r["relation"], r["mechanisms"]) for k, r in enumerate(found)], columns=["pair_id", "place", "column", "mapping", "relation", "mechanisms"])


def _gathered(pairs: DataFrame, turns: DataFrame, window: str) -> DataFrame:
    terms = pairs.select(F.col("id").alias("pair_id"), F.concat("shared_terms", "markers").alias("terms"))
    t = window_turns(pairs, turns, window).groupBy("pair_id").agg(F.collect_list(F.struct("turn_index", "id", "speaker_label", "turn_text")).alias("turns"))
    return t.join(terms, "pair_id")


def grid(pairs: DataFrame, turns: DataFrame, window: str = "pair") -> DataFrame:
    return _gathered(pairs, turns, window).mapInPandas(_grid_rows, _GRID)


def relations(pairs: DataFrame, turns: DataFrame, window: str = "pair") -> DataFrame:
    return _gathered(pairs, turns, window).mapInPandas(_relation_rows, _RELATIONS)


def mechanism_summary(related: DataFrame) -> DataFrame:
    """For each mechanism the number of relations that show it; with no scorer installed the state is rule or none."""
    n = related.select(F.explode("mechanisms").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    keys = related.sparkSession.createDataFrame([(i, k, t) for i, (k, t) in enumerate(diagraph.THRESHOLDS.items())], "place int, key string, threshold double")
    out = keys.join(n, "key", "left").select("place", "key", "threshold", F.coalesce("n", F.lit(0)).alias("rule_support"))
    return out.withColumn("support_state", F.when(F.col("rule_support") > 0, "rule").otherwise("none"))


def described(related: DataFrame) -> DataFrame:
    """Relations with what pages say about each."""
    notes = F.create_map(*[F.lit(x) for kv in L.RELATION_NOTES.items() for x in kv])
    return related.withColumn("description", F.coalesce(notes[F.col("relation")], F.lit("")))


_PAYLOAD = "pair_id long, columns array<string>, grid array<struct<row_no:int,speaker:string,cells:array<struct<key:string,value:string>>>>, turns array<struct<row_no:int,id:long,speaker:string,text:string>>, affordances array<struct<place:int,column:string,mapping:string,relation:string,description:string>>, supported array<string>"


def _payload_rows(it):
    for pair, rows, grid in _grids(it):
        cells, found = grid.named_cells(), grid.relations()
        row = {
            "pair_id": pair,
            "columns": sorted({c for r in cells for c in r}, key=lambda c: (len(c), c)),
            "grid": [{"row_no": t[0], "speaker": t[2], "cells": [{"key": k, "value": v} for k, v in r.items()]} for t, r in zip(rows, cells, strict=True)],
            "turns": [{"row_no": n, "id": i, "speaker": s, "text": x} for n, i, s, x in rows],
            "affordances": [{"place": k, "column": r["column"], "mapping": r["mapping"], "relation": r["relation"], "description": L.RELATION_NOTES.get(r["relation"], "")} for k, r in enumerate(found)],
            "supported": sorted({m for r in found for m in r["mechanisms"]}),
        }
        yield pd.DataFrame([row])


def payloads(pairs: DataFrame, turns: DataFrame, window: str = "pair") -> DataFrame:
    """One row for each pair: its turns, the grid's column names and rows, relations, and support of mechanisms, as nested values. The turns
    are gathered once, and grid and relations come from one alignment."""
    return _gathered(pairs, turns, window).mapInPandas(_payload_rows, _PAYLOAD).withColumn("window", F.lit(window))


_SCORES = "pair_id long, key string, probability double, threshold double, suggested boolean"


def relation_scores(pairs: DataFrame, scorer=None) -> DataFrame:
    """Probabilities of the six mechanisms for each pair (id, text_a, text_b). scorer: a function that workers can import or
    unpickle, from two lists of texts to one dict of probabilities for each pair. Without one, which is the default as no
    model comes with this package, nothing is available and there are no rows."""
    if scorer is None:
        return pairs.sparkSession.createDataFrame([], _SCORES)

    def run(frames_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames_:
            scored = scorer(f["text_a"].tolist(), f["text_b"].tolist())
            rows = [(pair, k, round(float(p[k]), 4), t, p[k] >= t) for pair, p in zip(f["id"], scored, strict=True) for k, t in diagraph.THRESHOLDS.items() if k in p]
            yield pd.DataFrame(rows, columns=["pair_id", "key", "probability", "threshold", "suggested"])

    return pairs.select("id", "text_a", "text_b").mapInPandas(run, _SCORES)


#: Pairs that a relation model is trained on, at most.
TRAINING_PAIRS = 4000


def trained_relations(pairs: DataFrame, turns: DataFrame, most: int = TRAINING_PAIRS) -> relation_model.RelationModel:
    """A model of the mechanisms that rules find, trained on a bounded sample: the `most` distinct pairs of texts of least hash. It
    generalises the rules to pairs in which their words are missing."""
    texts = pairs.groupBy("text_a", "text_b").agg(F.min("id").alias("id")).orderBy(F.xxhash64("text_a", "text_b"), "id").limit(most)
    sample = pairs.join(F.broadcast(texts.select("id")), "id", "left_semi")
    found = relations(sample, turns).select("pair_id", F.explode("mechanisms").alias("key")).groupBy("pair_id").agg(F.collect_set("key").alias("shown"))
    rows = sample.join(found, sample.id == found.pair_id, "left").select("text_a", "text_b", "shown").collect()  # `most` rows
    rows.sort(key=lambda r: (r["text_a"] or "", r["text_b"] or ""))
    return relation_model.train([r["text_a"] for r in rows], [r["text_b"] for r in rows], [set(r["shown"] or ()) for r in rows], tuple(diagraph.THRESHOLDS))


def pair_support(related: DataFrame, scores: DataFrame) -> DataFrame:
    """For each pair and mechanism whether rules, the scorer, both (joint) or neither support it."""
    n = related.select("pair_id", F.explode("mechanisms").alias("key")).groupBy("pair_id", "key").agg(F.count(F.lit(1)).alias("rule_support"))
    both = n.join(scores, ["pair_id", "key"], "full")
    rule, yes = F.coalesce("rule_support", F.lit(0)), F.coalesce("suggested", F.lit(False))
    state = F.when((rule > 0) & yes, "joint").when(rule > 0, "rule").when(yes, "bert_review").otherwise("none")
    return both.select("pair_id", "key", rule.alias("rule_support"), "probability", state.alias("support_state"))
