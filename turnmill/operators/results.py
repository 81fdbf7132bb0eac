"""Columns and rows that a results page shows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import context
from ..functions.lexicon import AUDIO_FILES, TEXT_DIALOGUE, VIDEO_FILES
from ..functions.text import blank, filled, strip

_CONTEXT = T.StructType([T.StructField(n, T.StringType()) for n in ("before", "hit", "after", "hit_html")])
_NAMES = ("content", "prev_segment", "current_segment", "segment_text", "next_segment", "speaker", "prev_speaker", "next_speaker")


def with_context(hits: DataFrame, keyword: str, left: int = 80, right: int = 80, regex: bool = False, interviews: Column | None = None) -> DataFrame:
    """before, hit, after and hit_html for each row, in Arrow batches; run it on a page, not on all hits."""

    @F.pandas_udf(_CONTEXT)
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        found = [context.segment(r, keyword, left, right, regex) for r in rows.to_dict("records")]
        return pd.DataFrame([(*f, context.highlight(f[1], keyword, regex)) for f in found], columns=_CONTEXT.names)

    have = [F.col(n).cast("string").alias(n) if n in hits.columns else F.lit(None).cast("string").alias(n) for n in _NAMES]
    flag = (F.lit(False) if interviews is None else interviews).alias("interview")
    return hits.withColumn("x", build(F.struct(*have, flag))).select("*", "x.*").drop("x")


def _escaped(text: Column) -> Column:
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(name))
    return text


def highlighted(df: DataFrame, text: str, keyword: str, markers: str | None = None) -> DataFrame:
    """`html` of a text; with a column of markers, these and the keyword overlaid. Whole texts with a keyword alone are marked in the JVM, row
    by row, as context.highlight() does."""

    @F.pandas_udf(T.StringType())
    def overlaid(t: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([context.highlight_resonance(x, list(y) if y is not None else [], keyword) for x, y in zip(t, m, strict=True)])

    if markers is not None:
        return df.withColumn("html", overlaid(text, markers))
    whole = F.coalesce(F.col(text), F.lit(""))
    if not keyword:
        return df.withColumn("html", _escaped(whole))
    literal = "\\Q" + keyword.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return df.withColumn("html", F.array_join(F.transform(F.split(whole, literal, -1), _escaped), context.highlight(keyword, keyword)))


def with_terms(df: DataFrame, text: str, terms: Column | str) -> DataFrame:
    """`html` of a text in which the longest of some terms are marked first."""

    @F.pandas_udf(T.StringType())
    def marked(t: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([context.highlight_terms(x, list(y) if y is not None else []) for x, y in zip(t, terms, strict=True)])

    return df.withColumn("html", marked(text, terms))


@F.pandas_udf(T.StringType())
def spoken(text: pd.Series, speaker: pd.Series) -> pd.Series:
    return pd.Series([context.spoken(t, s) for t, s in zip(text, speaker, strict=True)])


@F.pandas_udf(T.StringType())
def normalize_ip(value: pd.Series) -> pd.Series:
    return value.map(context.normalize_ip)


@F.pandas_udf(T.StringType())
def mask_ip(value: pd.Series) -> pd.Series:
    return value.map(context.mask_ip)


def client_ip(cf_ip: Column, cf_ray: Column, forwarded: Column, remote: Column, trusted: Column) -> Column:
    """The proxy's header only with its ray id, then the first forwarded address if the proxy is trusted, then the peer's."""
    first = F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))
    pick = lambda c, ok: F.when(ok, F.nullif(normalize_ip(c), F.lit("")))
    return F.coalesce(pick(cf_ip, F.coalesce(cf_ray, F.lit("")) != ""), pick(first, trusted), normalize_ip(remote))


def staged(rows: DataFrame, dataset: str, note: str, categories: dict[str, str]) -> DataFrame:
    """Export rows made ready for import: one stored source, plain titles, the dataset's category, a source of the crawl."""
    cell = lambda n: strip(F.coalesce(F.col(n), F.lit(""))) if n in rows.columns else F.lit("")
    title = cell("title")
    for old in ("LLM分块抽取单元", "LLM全文抽取", "规则会话单元"):
        title = F.replace(title, F.lit(old), F.lit("对话单元"))
    name = F.coalesce(filled(cell("dataset_name")), F.lit(dataset))
    known = F.create_map(*[F.lit(x) for kv in categories.items() for x in kv]) if categories else F.create_map(F.lit(""), F.lit(""))
    return rows.withColumns({"title": title, "dataset_name": name, "category": F.coalesce(known[name], F.lit("")), "crawl_source": F.coalesce(filled(cell("crawl_source")), filled(cell("source")), F.lit(note)), "license_note": F.coalesce(filled(cell("license_note")), F.lit(note)), "source": F.lit(TEXT_DIALOGUE)})


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^./]+)$", 1))


def is_video(name: Column, mime: Column) -> Column:
    return extension(name).isin(*VIDEO_FILES) | mime.startswith("video/")


def transcribable(name: Column, mime: Column) -> Column:
    return extension(name).isin(*AUDIO_FILES, *VIDEO_FILES) | mime.startswith("audio/") | mime.startswith("video/")


def uploadable(name: Column, allowed: tuple[str, ...]) -> Column:
    return extension(name).isin(*allowed)


def audio_url(name: Column, base: str = "https://files/") -> Column:
    """Where an audio file is played from: an address as it is, a name below the store's base."""
    name = F.nullif(F.trim(name), F.lit(""))
    return F.when(name.rlike("^https?://"), name).otherwise(F.concat(F.lit(base), F.regexp_replace(name, "^/+", "")))


def audio_plan(entries: DataFrame, listed: DataFrame) -> DataFrame:
    """(audio_file, uploaded) for each named file, from a listing of those that the store has."""
    there = listed.select("audio_file").distinct().withColumn("uploaded", F.lit(True))
    return entries.where(~blank(F.col("audio_file"))).select("audio_file").distinct().join(there, "audio_file", "left").select("audio_file", F.coalesce("uploaded", F.lit(False)).alias("uploaded"))
