"""Many terms in one pass over each text, by an automaton of all of them (Aho-Corasick), in Arrow batches.

Built-in functions look for one term after another, which is right for a few; here the work of a text does not depend on how many
terms there are. The list is the caller's and travels with the function."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.context import mark_up


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Of the terms that are not empty; each gives its first place in the list and its length."""
    made = ahocorasick.Automaton()
    for k, t in enumerate(terms):
        if t and t not in made:
            made.add_word(t, (k, len(t)))
    made.make_automaton()
    return made


def contained(found: ahocorasick.Automaton, text: str | None) -> list[int]:
    """The places in the list of all terms that the text contains, in order."""
    return sorted({k for _, (k, _) in found.iter(text)}) if text and len(found) else []


def spans(found: ahocorasick.Automaton, text: str | None) -> list[tuple[int, int]]:
    """Places of terms from the left, at each the longest, none over another."""
    if not text or not len(found):
        return []
    longest: dict[int, int] = {}
    for end, (_, n) in found.iter(text):
        begin = end + 1 - n
        longest[begin] = max(longest.get(begin, 0), n)
    out, free = [], 0
    for begin in sorted(longest):
        if begin >= free:
            free = begin + longest[begin]
            out.append((begin, free))
    return out


def with_terms_in(df: DataFrame, text: str, terms: list[str], name: str = "terms") -> DataFrame:
    """`name`: the terms that the text contains, in the list's order, as markers_in() gives them. A null text has none."""
    terms = list(dict.fromkeys(terms))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    kind = f"row {df.schema.simpleString()}, terms array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(terms)
        for batch in batches:
            made = [[terms[k] for k in contained(found, t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(made, pa.list_(pa.string()))], names=["row", "terms"])

    return rows.mapInArrow(run, kind).select(*[F.col("row")[c].alias(c) for c in df.columns if c != name], F.col("terms").alias(name))


def with_marks(df: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(key, html): texts with the terms marked, from the left, at each place the longest, as with_terms() marks a row's own."""
    terms = list(dict.fromkeys(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(terms)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([mark_up(t or "", spans(found, t)) for t in batch.column(1).to_pylist()], pa.string())], names=["key", "html"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"key {kind}, html string").withColumnRenamed("key", key)


def term_counts(df: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """(term, n_texts) of all terms that stand in a text."""
    found = with_terms_in(df.select(F.col(text).alias("text")), "text", terms)
    return found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_texts"))
