"""Scalar text functions as Columns; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

#: Python's idea of white space: Unicode spaces and the four ASCII separators.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def normalize_turn(c: Column) -> Column:
    """Null as empty; white space collapsed and stripped."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", " "))


def line_feeds(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n|\r", "\n")


def content_hash(c: Column) -> Column:
    return F.sha2(line_feeds(strip(F.coalesce(c, F.lit("")))), 256)


def clean_text(c: Column) -> Column:
    return strip(line_feeds(F.coalesce(c, F.lit(""))))


def segment_hash(file: Column, start: Column, end: Column, text: Column) -> Column:
    return F.sha2(F.format_string("%s|%.3f|%.3f|%s", file, start, end, text), 256)


def parse_year(c: Column) -> Column:
    return strip(c).try_cast("int")


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def filled(c: Column) -> Column:
    """Null where blank as SQL's nullif(x, '') has it: only the empty string counts."""
    return F.nullif(c, F.lit(""))


def display_source(source: Column, category: Column) -> Column:
    return F.when((source == L.TEXT_DIALOGUE) & category.isin(*L.ANCIENT_CATEGORIES), L.ANCIENT).otherwise(F.coalesce(source, F.lit("")))


def display_title(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}*合并大对话{SPACE}*", " "), f"{SPACE}{{2,}}", " "))


def conversation_key(conversation_id: Column, entry_id: Column) -> Column:
    return F.coalesce(filled(conversation_id), F.concat(F.lit("entry:"), entry_id.cast("string")))


def search_text(*columns: Column) -> Column:
    return F.concat_ws(" ", F.filter(F.array(*[strip(F.coalesce(c.cast("string"), F.lit(""))) for c in columns]), lambda x: x != ""))


def escape_like(value: str) -> str:
    return value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def like_pattern(value: str, mode: str) -> str:
    safe = escape_like(value)
    return {"exact": safe, "starts_with": f"{safe}%", "ends_with": f"%{safe}"}.get(mode, f"%{safe}%")


def truncate(c: Column, most: int) -> Column:
    """The text up to `most` characters, with three dots if it was longer."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def entry_context(c: Column, most: int) -> Column:
    """Struct of context and truncated, at 200 to 6000 characters."""
    most = min(max(most, 200), 6000)
    return F.struct(truncate(c, most).alias("context"), (F.length(c) > most).alias("truncated"))


def fragment_label(key: Column, first: Column, last: Column) -> Column:
    return F.format_string("%s · %d-%d", key, first, last)


def origin_label(crawl_source: Column, dataset: Column, category: Column) -> Column:
    """Where a row comes from, as far as it is known."""
    return F.coalesce(filled(crawl_source), filled(dataset), filled(category), F.lit(""))


def utc_timestamp(at: Column) -> Column:
    """A moment as ISO text in UTC, to the second."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def terms_from_json(c: Column) -> Column:
    """A JSON array of terms; what is none counts as empty."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def mask_ip4(c: Column) -> Column:
    return F.regexp_replace(c, r"\.\d+$", ".*")


def visitor_hash(secret: str, visitor: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{secret}:"), visitor), 256)


def format_count(c: Column) -> Column:
    return F.format_number(c, 0)


def contains_any(c: Column, terms: tuple[str, ...]) -> Column:
    """Markers as fixed strings, in one pass: the shorter ones make the longer ones superfluous."""
    kept = [t for t in terms if not any(o != t and o in t for o in terms)]
    out = F.lit(False)
    for t in kept:
        out = out | c.contains(t)
    return out


def markers_in(c: Column, terms: tuple[str, ...]) -> Column:
    """The terms that the text contains, in their order."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(c, t))


def frames_in_both(a: Column, b: Column) -> Column:
    """Labels of frames that both texts use, and of a why answered by a because."""
    found = [F.when(a.rlike(p) & b.rlike(p), F.lit(label)) for label, p in L.FRAMES]
    found.append(F.when(a.contains("为什么") & b.contains("因为"), F.lit("为什么...因为")))
    return F.array_compact(F.array(*found))


def is_valid_label(label: Column) -> Column:
    """Whether a label names a speaker: known labels and role terms first, then terms that never do, then shape."""
    label = normalize_turn(label)
    compact = F.regexp_replace(label, f"{SPACE}+", "")
    has = lambda terms: F.regexp_like(compact, F.lit("|".join(terms)))
    return F.when((compact == "") | (F.length(compact) > 34) | label.rlike(f"[{L.LABEL_PUNCTUATION}]"), False).when(compact.isin(*L.EXACT_LABELS) | has(L.ROLE_TERMS), True).when(has(L.NON_SPEAKER_TERMS), False).otherwise(compact.rlike("^[一-鿿·]{2,8}$") | label.rlike("^[A-Za-z][A-Za-z0-9_ -]{0,15}$"))


def is_valid_bracket_label(label: Column) -> Column:
    label = normalize_turn(label)
    compact = F.regexp_replace(label, f"{SPACE}+", "")
    bad = (compact == "") | (F.length(compact) > 16) | label.rlike(f"[{L.LABEL_PUNCTUATION}]") | F.regexp_like(compact, F.lit("|".join(L.NON_SPEAKER_TERMS)))
    return F.when(bad, False).otherwise(is_valid_label(label) | compact.rlike("^[一-鿿·]{1,8}$"))


def parse_speaker(line: Column) -> Column:
    """Struct of speaker ('' if none) and text, from `【x】：text`, `[x]:text` or `label：text`; a label has 32 characters at most."""
    line = normalize_turn(line)

    def parts(pattern: str, valid) -> tuple[Column, Column]:
        label, text = F.regexp_extract(line, pattern, 1), strip(F.regexp_extract(line, pattern, 2))
        fit = (text != "") & ~label.startswith(" ") & (F.length(F.rtrim(label)) <= 32) & valid(label)
        return fit, F.struct(strip(label).alias("speaker"), text.alias("text"))

    in_brackets, plain = parts(r"^[\[【]([^\]】]+)[\]】] ?[:：](.+)", is_valid_bracket_label), parts("^([^:：]+)[:：](.+)", is_valid_label)
    return F.when(*in_brackets).when(*plain).otherwise(F.struct(F.lit("").alias("speaker"), line.alias("text")))


def normalize_speaker(speaker: Column, text: Column) -> Column:
    """Struct of speaker and text: a label inside the text replaces a missing, invalid or equal speaker."""
    speaker, text = normalize_turn(speaker), normalize_turn(text)
    own = parse_speaker(text)
    take = (own["speaker"] != "") & (own["text"] != "") & (speaker.isin(*L.PLACEHOLDER_LABELS) | ~is_valid_label(speaker) | (speaker == own["speaker"]))
    return F.when(take, own).otherwise(F.struct(speaker.alias("speaker"), text.alias("text")))


def resonance_tokens(text: Column, most: int = 24) -> Column:
    """Chunks of Latin or Han characters that are no stopwords, then Han bigrams without stop characters; the first of each."""
    text = normalize_turn(text)
    stop = F.array(*[F.lit(w) for w in sorted(L.STOPWORDS)])
    chunks = F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]{2,}|[一-鿿]{2,6}"), F.lit(0)), lambda t: ~F.array_contains(stop, t))
    han = F.regexp_replace(text, "[^一-鿿]+", "")
    pairs = F.when(F.length(han) >= 2, F.transform(F.sequence(F.lit(1), F.length(han) - 1), lambda i: F.substr(han, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    edge = "".join(sorted(L.STOP_CHARS))
    pairs = F.filter(pairs, lambda t: ~F.rlike(t, F.lit(f"[{edge}]")) & ~F.array_contains(stop, t))
    return F.slice(F.array_distinct(F.concat(chunks, pairs)), 1, most)
