"""Overlapping dialogue windows folded into dialogues, in pieces side by side.

Whether a window continues a dialogue depends on all windows before it, but a dialogue depends only on the window that it
starts with. So the windows, in their order, are dealt to pieces of about equal size, and each piece is folded as if a dialogue started
with it. Where the dialogue that the piece before ends in takes in the piece's first window, the piece is folded again from that
dialogue, up to a window where both ways start a dialogue: from there on they are the same. A dialogue that covers a whole piece
goes on into the next one in another round."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grammar, windows
from ..shipping import Working
from .ingest import with_ids

MERGED = "dataset_name string, dialogue_id string, title string, chapter string, content string, turn_count int, speakers string, source_titles string, merges int, contained int, duplicates int, inside int"
_SAID = "array<struct<speaker:string,body:string>>"
_UNITS = f"dataset_name string, row_index long, title string, chapter string, chunk_id string, said {_SAID}"
_LABELLED = f"place long, start long, dataset_name string, title string, chapter string, chunk_id string, said {_SAID}"
_MOVED = "stream long, place long, start long, ended boolean"
_DIALOGUES = "start long, dataset_name string, chapter string, content string, turn_count int, speakers string, source_titles string, chunks array<long>, merges int, contained int, key array<string>, digest string"
#: Places are numbered in each piece, whose number stands in the bits above.
_PIECE = 33


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Windows of two turns or more."""
    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            turns = grammar.merge_turns((r.content or "").replace("\r\n", "\n").replace("\r", "\n"))
            if len(turns) > 1:
                out.append((r.dataset_name, r.row_index, r.title or "", r.chapter or "", r.chunk_id, [{"speaker": s, "body": t} for s, t in turns]))
        yield pd.DataFrame(out, columns=_names(_UNITS))


def _turns(row) -> windows.Turns:
    return [(x["speaker"], x["body"]) for x in row.said]


def _continues(open_: windows.Dialogue | None, row) -> bool:
    return open_ is not None and open_.dataset == row.dataset_name and open_.absorb(row.chapter, _turns(row))


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each window of a piece with the place of the one that its dialogue starts with."""
    open_, start = None, None
    for frame in frames:
        starts = []
        for r in frame.itertuples(index=False):
            if not _continues(open_, r):
                open_, start = windows.Dialogue(r.dataset_name, r.chapter, _turns(r)), r.place
            starts.append(start)
        yield frame.assign(start=starts)[_names(_LABELLED)]


def _refold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams of (stream, first, place, start, ...): the windows before `first`, which are one dialogue, then those of a piece. Out come
    the starts that change, and a row without place: the start of the dialogue open at the end, and whether the folds met before it."""
    stream, open_, start, met, out = None, None, None, False, []
    for frame in frames:
        for r in frame.itertuples(index=False):
            if r.stream != stream:
                if stream is not None:
                    out.append((stream, None, start, met))
                stream, open_, start, met = r.stream, None, None, False
            if met or _continues(open_, r):
                if not met and r.place >= r.first:
                    out.append((stream, r.place, start, None))
                continue
            if open_ is not None and r.start == r.place:
                met = True
                continue
            open_, start = windows.Dialogue(r.dataset_name, r.chapter, _turns(r)), r.place
            if r.place >= r.first:
                out.append((stream, r.place, start, None))
        yield pd.DataFrame(out, columns=_names(_MOVED)).astype({"place": "Int64", "start": "Int64"})
        out = []
    if stream is not None:
        yield pd.DataFrame([(stream, None, start, met)], columns=_names(_MOVED)).astype({"place": "Int64", "start": "Int64"})


def _build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The dialogue of each start; its windows come side by side, in order."""
    at, made = None, None

    def one() -> tuple:
        key = ["\x1f".join(x) for x in made.key]
        return (at, made.dataset, made.chapter, "\n".join(f"【{s}】：{t}" for s, t in made.turns), len(made.turns), "、".join(dict.fromkeys(s for s, _ in made.turns)), " | ".join(made.titles[:20]), made.chunks, made.merges, made.contained, key, hashlib.sha256("\x1e".join(key).encode()).hexdigest())

    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            if r.start != at:
                if made is not None:
                    out.append(one())
                at, made = r.start, windows.Dialogue(r.dataset_name, r.chapter, _turns(r))
            else:
                made.absorb(r.chapter, _turns(r))
            made.take(r.title, windows.chunk_of(r.chunk_id))
        yield pd.DataFrame(out, columns=_names(_DIALOGUES))
    if made is not None:
        yield pd.DataFrame([one()], columns=_names(_DIALOGUES))


def _inside(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"start": [s for s, small, large in zip(f["start"], f["small"], f["large"]) if windows.place_of(list(small), list(large)) >= 0]}, dtype="int64")


def starts(units: DataFrame, work: Working, pieces: int | None = None) -> DataFrame:
    """The windows of two turns or more, parsed, in their order (place), each with the place that its dialogue starts at."""
    order = ["dataset_name", "row_index", "chunk_id", "title"]
    parsed = units.select("dataset_name", F.col("row_index").cast("long").alias("row_index"), "title", "chapter", "chunk_id", "content").mapInPandas(_parse, _UNITS)
    dealt = (parsed.repartitionByRange(pieces, *order) if pieces else parsed.repartitionByRange(*order)).sortWithinPartitions(*order)
    alone = work.table("alone", dealt.withColumn("place", F.monotonically_increasing_id()).mapInPandas(_fold, _LABELLED)).withColumn("piece", F.shiftright("place", _PIECE))
    # a row for each piece goes through the driver
    heads = [tuple(r) for r in alone.groupBy("piece").agg(F.min("place"), F.max("start")).orderBy("piece").collect()]
    first, ends = {p: x for p, x, _ in heads}, {p: x for p, _, x in heads}  # ends: where the dialogue starts that is open at the piece's end
    alone_ends, before = dict(ends), {q: p for (p, *_), (q, *_) in zip(heads, heads[1:])}
    used: dict[int, int] = {}
    moved: dict[int, tuple[int, DataFrame]] = {}

    def streams(todo: list[int], whole: bool) -> DataFrame:
        """The open dialogue before each piece and the piece, or of it the first window."""
        rows = [(q, p, first[q], ends[before[q]], None if whole else first[q]) for q in todo for p in first if ends[before[q]] >> _PIECE <= p <= q]
        at = alone.sparkSession.createDataFrame(rows, "stream long, piece long, first long, least long, most long")
        both = alone.join(F.broadcast(at), "piece").where("place >= least AND (most IS NULL OR place <= most)")
        return both.select("stream", "first", *_names(_LABELLED)).repartition("stream").sortWithinPartitions("stream", "place").mapInPandas(_refold, _MOVED)

    k = 0
    while todo := [q for q in before if used.get(q) != ends[before[q]]]:
        k += 1
        for q in todo:
            used[q], ends[q] = ends[before[q]], alone_ends[q]
            moved.pop(q, None)
        shut = {r.stream for r in work.table(f"first{k}", streams(todo, False)).where("place IS NULL AND ended").collect()}
        if again := [q for q in todo if q not in shut]:
            found = work.table(f"moved{k}", streams(again, True))
            for r in found.where("place IS NULL").collect():
                moved[r.stream] = (k, found)
                ends[r.stream] = alone_ends[r.stream] if r.ended else r.start
    if not moved:
        return alone
    new = None
    for round_ in sorted({k for k, _ in moved.values()}):
        found = next(df for k, df in moved.values() if k == round_)
        own = found.where(F.col("stream").isin([q for q, (k, _) in moved.items() if k == round_]) & F.col("place").isNotNull()).select("place", F.col("start").alias("new"))
        new = own if new is None else new.unionByName(own)
    return alone.join(new, "place", "left").withColumn("start", F.coalesce("new", "start")).drop("new")


def merge_windows(units: DataFrame, pieces: int | None = None) -> DataFrame:
    """Dialogues from overlapping windows (dataset_name, row_index, title, chapter, chunk_id, content) in row order, equal ones of a
    chapter once, and none inside another of its chapter whose chunks are near.

    A window continues the open dialogue of its dataset if it lies inside it, around it, or begins with its end. Windows of fewer than two
    turns go; of equal row_index that of least chunk_id, then title comes first; null titles and chapters are empty."""
    spark = units.sparkSession
    work = Working(spark, "windows")
    labelled = starts(units, work, pieces)
    made = work.table("made", labelled.select("place", "start", "dataset_name", "title", "chapter", "chunk_id", "said").repartition("start").sortWithinPartitions("start", "place").mapInPandas(_build, _DIALOGUES))
    unique = made.groupBy("dataset_name", "chapter", "digest").agg(F.min("start").alias("start")).select("start")
    kept = work.table("kept", made.join(unique, "start"))
    # a dialogue around another has all its pairs of turns; so each looks for those that have the rarest of its own
    pairs = F.transform(F.sequence(F.lit(0), F.size("key") - 2), lambda i: F.xxhash64("dataset_name", "chapter", F.get("key", i), F.get("key", i + 1)))
    spread = work.table("pairs", kept.select("start", F.explode(F.array_distinct(pairs)).alias("pair")))
    rarest = spread.join(spread.groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair").groupBy("start").agg(F.min(F.struct("n", "pair")).alias("x")).where("x.n > 1").select("start", "x.pair")
    asked = rarest.join(spread.withColumnRenamed("start", "other"), "pair").where("start <> other").select("start", "other").distinct()
    small = kept.select("start", "dataset_name", "chapter", "chunks", F.col("key").alias("small"))
    large = kept.select(F.col("start").alias("other"), F.col("dataset_name").alias("their_set"), F.col("chapter").alias("their_chapter"), F.col("chunks").alias("their_chunks"), F.col("key").alias("large"))
    near = F.exists("chunks", lambda a: F.exists("their_chunks", lambda b: F.abs(a - b) <= 1))
    both = asked.join(small, "start").join(large, "other").where(F.col("dataset_name").eqNullSafe(F.col("their_set")) & (F.col("chapter") == F.col("their_chapter")) & (F.size("small") < F.size("large")) & near)
    within = work.table("within", both.select("start", "small", "large").mapInPandas(_inside, "start long").distinct())
    left = kept.join(within, "start", "left_anti")
    # numbers in each dataset, from places, which go through all datasets in order
    numbered = with_ids(left.select("start", "dataset_name"), 0, "start")
    counts = made.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n"))
    n_kept = kept.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n_kept"))
    totals = numbered.groupBy("dataset_name").agg(F.min("id").alias("base"), F.count(F.lit(1)).alias("n_left"))
    same = lambda df, name: df.withColumnRenamed("dataset_name", name)
    totals = totals.join(same(counts, "d1"), F.col("dataset_name").eqNullSafe(F.col("d1"))).join(same(n_kept, "d2"), F.col("dataset_name").eqNullSafe(F.col("d2")))
    totals = totals.select(F.col("dataset_name").alias("d"), "base", (F.col("n") - F.col("n_kept")).cast("int").alias("duplicates"), (F.col("n_kept") - F.col("n_left")).cast("int").alias("inside"))
    k = (F.col("id") - F.col("base") + 1).cast("string")
    named = left.join(numbered.select("start", "id"), "start").join(totals, F.col("dataset_name").eqNullSafe(F.col("d"))).withColumn("number", F.lpad(k, F.greatest(F.lit(4), F.length(k)), F.lit("0")))
    title = F.concat(F.lit("《"), "dataset_name", F.lit("》"), F.when(F.col("chapter") != "", F.concat("chapter", F.lit(" "))).otherwise(""), F.lit("合并大对话 "), "number")
    named = named.withColumns({"dialogue_id": F.concat_ws("_", "dataset_name", "number"), "title": title})
    return named.select(*_names(MERGED))


def merge_report(merged: DataFrame) -> DataFrame:
    return merged.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("dialogues"), F.sum("merges").alias("merges"), F.sum("contained").alias("contained"), F.max("duplicates").alias("duplicates"), F.max("inside").alias("inside"), F.max("turn_count").alias("max_turns"), F.round(F.avg("turn_count"), 2).alias("avg_turns"))
