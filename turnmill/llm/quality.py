"""Quality rules by distribution divergence, in DataFrame functions only.

The Jensen-Shannon distance (base 2, square root) between a document's histogram of character classes and that of its
language, and likewise for its common words, tells prose from tables, symbol noise, codes and shouting. References are
counted over all documents of a language. Documents below a minimum length are not judged by divergence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch, pick

#: What prose mostly consists of. The few characters that remain are then looked at class by class: capitals, digits,
#: marks and ASCII symbols; letters and space are counted as what the first removal took, all else makes a last class.
BULK = r"[a-zß-öø-ÿ\x20\x09-\x0D]+"
CLASSES = ("[A-Z]+", "[0-9]+", r"[.,;:!?'\"()\-]+", r"[#$%&*+/<=>@\[\]\\^_`{|}~]+")


@dataclass(frozen=True)
class Limits:
    common_words: int = 16
    #: Longer words are never among a language's common words, which are function words.
    common_length: int = 6
    #: Below so many words, and above so many per cent of words in repeated 3-word windows, a document fails at once.
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Words that a document must have for each divergence to be judged, and the largest distances that pass.
    classes_from: int = 50
    words_from: int = 100
    class_distance: float = 0.30
    word_distance: float = 0.27


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def class_counts(text: Column, bare: Column, spaces: Column) -> Column:
    """bare: the text without BULK. Counts of letters, white space, each of CLASSES, and the rest."""
    found = [F.length(bare) - F.length(F.regexp_replace(bare, pattern, "")) for pattern in CLASSES]
    rest = F.length(bare)
    for c in found:
        rest = rest - c
    return F.array(*[c.cast("long") for c in (F.length(text) - F.length(bare) - spaces, spaces, *found, rest)])


def js_distance(counts: Column, reference: Column) -> Column:
    """Of two count arrays of one length; null if either is all zero."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    n, m = total(counts), total(reference)
    pairs = F.zip_with(counts, reference, lambda c, r: F.struct((c / n).alias("p"), (r / m).alias("q")))
    divergence = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + (part(x["p"], (x["p"] + x["q"]) / 2) + part(x["q"], (x["p"] + x["q"]) / 2)) / 2)
    return F.when((n > 0) & (m > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


def common_words(docs: DataFrame, limits: Limits) -> DataFrame:
    """lang and its most common words (ref_words, the most common first) over all documents of (lang, text)."""
    short = F.filter(words(F.col("text")), lambda w: F.length(w) <= limits.common_length)
    counted = docs.select("lang", F.explode(short).alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.where(F.col("w").rlike(r"^\p{L}+$")).groupBy("lang", F.lower("w").alias("w")).agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "w")
    top = counted.withColumn("r", F.row_number().over(first)).where(F.col("r") <= limits.common_words)
    return top.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]).alias("ref_words"))


def _small(df: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """A table of a row for each language, to broadcast if it has as few rows as languages have."""
    written = scratch.table(name, df)
    return F.broadcast(written) if written.count() <= 1000 else written


def measures(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The base figures and both distances for each row of (doc_id, lang, text)."""
    scratch = Scratch(docs.sparkSession, "quality")
    docs = pick(docs, "doc_id", "lang", "text").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    known = _small(common_words(docs, limits), scratch, "words")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.join(known, "lang", "left").select("doc_id", "lang", "text", F.coalesce("ref_words", F.array().cast("array<string>")).alias("ref_words"), words(F.col("text")).alias("w"), lines.alias("lines"), F.regexp_replace("text", BULK, "").alias("bare"))
    n = F.size("w")
    df = df.select(
        "doc_id", "lang", "text", "bare", "ref_words", "w",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("bare") - F.length(F.translate("bare", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.filter(F.transform(F.filter("w", lambda x: F.length(x) <= limits.common_length), lambda x: F.array_position("ref_words", F.lower(x))), lambda k: k > 0).alias("hits"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<long>")).alias("windows"),
    )
    # windows that occur twice stand side by side in the order of (hash, words, place); most documents have none and sort nothing
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    window = lambda h, i: F.struct(h.alias("h"), F.get("w", i).alias("a"), F.get("w", i + 1).alias("b"), F.get("w", i + 2).alias("c"))
    df = df.withColumn("ordered", F.when(twice, F.sort_array(F.transform("windows", lambda h, i: F.struct(window(h, i).alias("k"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(F.get("ordered", j)["k"] == x["k"], F.lit(False))
    df = df.withColumn("places", F.when(F.col("ordered").isNotNull(), F.sort_array(F.transform(F.filter("ordered", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))))
    # each place covers three words, fewer where the next place follows closely
    covered = F.aggregate(F.transform("places", lambda p, i: F.least(F.coalesce(F.get("places", i + 1) - p, F.lit(3)), F.lit(3))), F.lit(0), lambda s, x: s + x)
    hits = F.transform(F.sequence(F.lit(1), F.greatest(F.size("ref_words"), F.lit(1))), lambda k: F.size(F.filter("hits", lambda x: x == k)).cast("long"))
    counted = scratch.table("counts", df.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        class_counts(F.col("text"), F.col("bare"), F.length("text") - F.col("word_chars")).alias("classes"),
        F.array_append(F.slice(hits, 1, F.size("ref_words")), F.col("n_words") - F.size("hits")).alias("word_counts"),
    ))
    total = lambda c, n: F.array(*[F.sum(F.coalesce(F.get(c, F.lit(k)), F.lit(0))) for k in range(n)])
    sums = counted.groupBy("lang").agg(total("classes", len(CLASSES) + 3).alias("ref_classes"), total("word_counts", limits.common_words + 1).alias("ref_counts"), F.max(F.size("word_counts")).alias("n"))
    references = _small(sums.select("lang", "ref_classes", F.slice("ref_counts", 1, F.col("n")).alias("ref_counts")), scratch, "references")
    return counted.join(references, "lang").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        js_distance(F.col("classes"), F.col("ref_classes")).alias("class_distance"),
        js_distance(F.col("word_counts"), F.col("ref_counts")).alias("word_distance"),
    )


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """measures() with base_failed and kept for each row of (doc_id, lang, text).

    A null or blank text has zero words and fails. A null lang counts as one language of its own; a language's only
    document is its own reference and passes the divergences. Repeated rows and null doc_ids stay; an empty table gives no
    rows; other columns are ignored. Texts of any length are taken whole."""
    m = measures(docs, limits)
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    strange = (F.col("n_words") >= limits.classes_from) & (F.col("class_distance") > limits.class_distance) | (F.col("n_words") >= limits.words_from) & (F.col("word_distance") > limits.word_distance)
    return m.select("*", failed.alias("base_failed"), (~failed & ~F.coalesce(strange, F.lit(False))).alias("kept"))
