"""Line dedup by a log-template tree of fixed depth.

A line's leaf is its number of tokens and its first ones, variable fields (tokens with digits) masked. In a leaf, lines that
agree in most places form a template, in which places that vary become fields. A template recurs if lines of it stand in
enough documents that are no copies of each other: a notice at the end of many documents does, the lines of a document and
its near copies do not, since these count as one. Lines of recurring templates are dropped from all documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap
from .common import Scratch, ship, slices, texts_of
from .simhash import components, min_hash_keys, word_shingles

FIELD = "<*>"
DIGIT = re.compile(r"\d")


@dataclass(frozen=True)
class Settings:
    #: Tokens that lead from the root to a leaf, after the number of tokens.
    depth: int = 3
    #: Tokens of a line, and documents with a line of the template that a line of so many tokens or more asks for: the longer,
    #: the less it recurs by chance. All near copies of one document together count as one.
    min_documents: tuple[tuple[int, int], ...] = ((21, 2), (8, 3), (3, 8), (1, 32))
    #: Share of places in which a line agrees with its template.
    similarity: float = 0.7
    bits: int = 27
    #: Near copies agree on the least hashes of their word pairs in a band: 0.5 % of two texts do that have a seventh of all pairs
    #: in common, 54 % at a half, 99 % at three quarters.
    bands: int = 12
    rows: int = 4

    def needed(self, tokens: int) -> int:
        return next(n for least, n in self.min_documents if tokens >= least)


def masked(line: str) -> list[str]:
    return [FIELD if DIGIT.search(t) else t for t in line.split()]


def _hash(parts: list[str]) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass"))


def leaf(tokens: list[str], depth: int) -> int:
    return _hash([str(len(tokens)), *tokens[:depth]])


class Lines:
    """The lines of a text that may belong to a template: place, leaf, and documents it needs. Blank lines
    and short ones without any fixed token may not."""

    def __init__(self, text: str, s: Settings):
        self.all = text.split("\n")
        self.places, self.leaves, self.needs = [], [], []
        for k, line in enumerate(self.all):
            tokens = line.split()
            lead = [FIELD if DIGIT.search(t) else t for t in tokens[: s.depth]]
            if len(tokens) < s.depth and all(t == FIELD for t in lead):
                continue
            self.places.append(k)
            self.leaves.append(_hash([str(len(tokens)), *lead]))
            self.needs.append(s.needed(len(tokens)))


class Leaf:
    """Templates of one leaf, whose lines share their length and their first `depth` tokens.

    A line joins a template if it differs from it, fields aside, in so few places that of one block more than that, cut from the tokens
    after the first, one has no difference. So templates are kept by each block as it is now, with the places that are fields, and a line
    looks each block up under every set of field places that templates have there. Those found are compared as rows of numbers."""

    def __init__(self, similarity: float, depth: int):
        self.similarity, self.depth, self.templates = similarity, depth, []
        self.numbers: dict[str, int] = {FIELD: 0}
        self.rows = np.zeros((0, 0), np.int32)

    def _start(self, n: int) -> None:
        self.first = min(self.depth, n)
        k = int(n * (1 - self.similarity) + 1e-9) + 1
        self.edges = [self.first + (n - self.first) * b // k for b in range(k + 1)]
        self.by_block: list[dict[tuple[int, ...], dict[bytes, list[int]]]] = [{} for _ in range(k)]
        self.rows = np.zeros((64, n), np.int32)

    def _keep(self, t: int, b: int) -> None:
        """Note the template under its block as it is now."""
        own = self.rows[t, self.edges[b] : self.edges[b + 1]]
        fields = tuple(np.flatnonzero(own == 0).tolist())
        self.by_block[b].setdefault(fields, {}).setdefault(own.tobytes(), []).append(t)

    def place(self, tokens: list[str]) -> int:
        """The number of the template that the line joins or founds."""
        n = len(tokens)
        if not len(self.rows):
            self._start(n)
        line = np.fromiter((self.numbers.setdefault(t, len(self.numbers)) for t in tokens), np.int32, n)
        found: set[int] = set()
        for b, kinds in enumerate(self.by_block):
            own = line[self.edges[b] : self.edges[b + 1]]
            for fields, blocks in kinds.items():
                asked = own.copy()
                asked[list(fields)] = 0
                found.update(blocks.get(asked.tobytes(), ()))
        if found:
            near = np.array(sorted(found))
            same = ((self.rows[near] == line) | (self.rows[near] == 0)).sum(axis=1)
            k = int(same.argmax())  # the first of equal ones
            if same[k] >= self.similarity * n:
                best = int(near[k])
                differ = np.flatnonzero((self.rows[best] != line) & (self.rows[best] != 0))
                self.rows[best, differ] = 0
                for i in differ.tolist():
                    self.templates[best][i] = FIELD
                for b in sorted({int(np.searchsorted(self.edges, i, side="right")) - 1 for i in differ.tolist()}):
                    self._keep(best, b)  # the entry as it was only makes it a candidate too often
                return best
        best = len(self.templates)
        if best == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[best] = line
        self.templates.append(list(tokens))
        for b in range(len(self.by_block)):
            self._keep(best, b)
        return best


def _whose(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def copies(docs: DataFrame, scratch: Scratch, s: Settings) -> DataFrame:
    """(node, root), the hashes of two texts, for each text that has near copies; all of a group have one root."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=2 << 20):
            texts = texts_of(batch)
            found = min_hash_keys(*word_shingles(texts, 2), s.bands, s.rows).view(np.int64)
            whose = np.array([_whose(t) for t in texts.to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(np.repeat(whose, s.bands))], names=["key", "node"])

    rows = scratch.table("keys", docs.select("text").mapInArrow(keys, "key long, node long").distinct(), "snappy")
    shared = rows.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b <> top").select("key", "b")
    return components(rows.join(shared, "key").select(F.col("node").alias("a"), "b"), scratch)


def recurring_lines(docs: DataFrame, scratch: Scratch, s: Settings) -> tuple[DataFrame, bytes]:
    """line_key (of the masked line) and template of all lines whose template recurs, and the bitmap of leaves that may hold any."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, needs, whose = [], [], []
            for t in texts_of(batch).to_pylist():
                lines = Lines(t, s)
                own = dict(zip(lines.leaves, lines.needs))
                found += own
                needs += own.values()
                whose += [_whose(t)] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.uint64()).view(pa.int64()) for x in (found, needs, whose)], names=["leaf", "need", "whose"])

    near = copies(docs, scratch, s)
    group = F.coalesce("root", "whose").alias("group")
    # a leaf's lines are equally long and so need the same; one that lies in copies of one document alone is not looked at again
    counts = docs.select("text").mapInArrow(leaves, "leaf long, need long, whose long").join(near, F.col("whose") == near.node, "left").select("leaf", "need", group)
    counts = counts.groupBy("leaf").agg(F.max("need").alias("need"), F.count(F.lit(1)).alias("n"), F.min("group").alias("low"), F.max("group").alias("high"))
    often = bitmap.build(counts.where("n >= need AND low <> high"), "leaf", s.bits)
    sent = docs.sparkSession.sparkContext.broadcast(often)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(sent.value, np.uint8)
        for batch in slices(batches):
            rows: dict[tuple, None] = {}
            for text in texts_of(batch).to_pylist():
                lines = Lines(text, s)
                if not lines.leaves:
                    continue
                whose = _whose(text)
                for i in np.flatnonzero(bitmap.test(marks, np.array(lines.leaves, np.uint64), s.bits)).tolist():
                    rows[(lines.leaves[i], "\x1f".join(masked(lines.all[lines.places[i]])), whose)] = None
            cols = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.uint64()).view(pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.uint64()).view(pa.int64())], names=["leaf", "line", "whose"])

    # equal texts count once, then near copies; each step has partial sums before the shuffle, and no row holds all groups of a line
    rows = docs.select("text").mapInArrow(candidates, "leaf long, line string, whose long").distinct()
    grouped = rows.join(near, rows.whose == near.node, "left").select("leaf", "line", group)
    parts = grouped.groupBy("leaf", "line", F.pmod("group", F.lit(256)).alias("part")).agg(F.collect_set("group").alias("some"))
    most = max(n for _, n in s.min_documents)
    lines = parts.groupBy("leaf", "line").agg(F.sum(F.size("some")).alias("n"), F.flatten(F.collect_list(F.slice("some", 1, most))).alias("some"))
    lines = lines.select("leaf", "line", "n", F.slice("some", 1, most).alias("some"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, held = None, None, []

        def close() -> list[tuple]:
            # as many groups are listed of each line as any needs, so fewer of a template are all of them
            seen, need = {}, s.needed(len(held[0][0].split("\x1f")))
            for _, t, some in held:
                seen.setdefault(t, set()).update(some)
            return [(_hash([x]), " ".join(tree.templates[t])) for x, t, _ in held if len(seen[t]) >= need]

        for batch in batches:
            out = []
            for h, line, some in zip(*(batch.column(c).to_pylist() for c in ("leaf", "line", "some"))):
                if h != at:
                    if held:
                        out += close()
                    at, tree, held = h, Leaf(s.similarity, s.depth), []
                held.append((line, tree.place(line.split("\x1f")), some))
            yield _verdicts(out)
        yield _verdicts(close() if held else [])

    ordered = lines.repartition("leaf").sortWithinPartitions("leaf", F.desc("n"), "line")
    return scratch.table("recurring", ordered.mapInArrow(parse, "line_key long, template string")), often


def _verdicts(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.uint64()).view(pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["line_key", "template"])


def drop_templates(docs: DataFrame, s: Settings = Settings(), counts: tuple[str, str] | None = ("n_lines", "n_dropped")) -> DataFrame:
    """The rows of docs, all their columns, with `text` less the lines of recurring templates, and two counts of its lines and of
    those dropped.

    docs has doc_id and text; columns of its own called as the counts are replaced, all others stay; without `counts` there are none
    and all stay. A null text stays null with no lines; an empty one has one empty line. Blank lines and those of one or two tokens
    that all have digits always stay. Equal texts and near copies count as one document, so a document that is merely copied keeps
    its lines. Lines that could join several templates alike join the one founded first, and lines come in order of how many
    documents hold them, then of their text. Repeated rows stay and lose the same lines; null doc_ids stay; an empty table gives no
    rows; texts of any length are taken whole."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "templates")
    text = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), "doc_id")
    recurring, often = recurring_lines(text, scratch, s)
    known = bitmap.build(recurring.select("line_key").distinct(), "line_key", s.bits)
    sent = spark.sparkContext.broadcast((often, known))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, keys = (np.frombuffer(x, np.uint8) for x in sent.value)
        for batch in slices(batches):
            out = []
            for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("tkey").to_pylist(), texts_of(batch).to_pylist()):
                lines = Lines(text, s)
                if lines.leaves:
                    for i in np.flatnonzero(bitmap.test(marks, np.array(lines.leaves, np.uint64), s.bits)).tolist():
                        out.append((doc, key, lines.places[i], _hash(["\x1f".join(masked(lines.all[lines.places[i]]))])))
            cols = list(zip(*out)) if out else [[]] * 4
            line_keys = np.array(cols[3], np.uint64)
            rows = pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(line_keys.view(np.int64))], names=["d", "t", "place", "line_key"])
            yield rows.filter(pa.array(bitmap.test(keys, line_keys, s.bits)))

    keyed = text.withColumn("tkey", F.xxhash64("text"))
    hit = keyed.mapInArrow(places, "d long, t long, place long, line_key long").join(recurring.select("line_key").distinct(), "line_key", "left_semi")
    drops = hit.groupBy("d", "t").agg(F.collect_set(F.col("place").cast("int")).alias("places"))
    # the row travels as one struct, so no column of its own can clash
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("doc"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("tkey"))
    # the lines are a column, since a function of each place would split the text anew for each
    both = whole.join(drops, F.expr("doc <=> d AND tkey = t"), "left").select("row", F.coalesce("places", F.array().cast("array<int>")).alias("places"), F.split("row.text", "\n", -1).alias("parts"))
    parts = F.col("parts")
    # the places that stay, by a hash set, then their lines
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "places")
    left = F.when(F.size("places") == 0, F.col("row.text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n"))
    kept = [left.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in (counts or ())]
    if counts:
        kept += [F.when(F.col("row.text").isNull(), 0).otherwise(F.size(parts)).alias(counts[0]), F.size("places").alias(counts[1])]
    return both.select(*kept)
