"""Near duplicates by min-max hashing.

Under each permutation of the shingle hashes both the least and the greatest of a document's are kept: each agrees between two
documents with the chance of their Jaccard similarity, so half the permutations give a whole signature, and of lower variance.
Bands of minima and bands of maxima bring candidates together, which whole sets of shingles confirm. Documents of one set
are one node from the start. In each bucket first every node is compared with the least one of its block; what that has not joined
meets all nodes of other groups: in small buckets as pairs, in large ones inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap
from .common import Scratch, pick, ship, slices, texts_of
from .simhash import FEW, SEED, SHARD_LIMIT, _shards, components, deal_hot, word_shingles

PERMUTATIONS, ROWS = 32, 4
#: Standard deviations by which the share of equal values of two signatures may fall short of the similarity.
SLACK = 5
#: Bits of the bitmap of rows whose sets are needed: 16 MB, whatever the corpus.
BITMAP_BITS = 27


def min_max(hashes: np.ndarray, offsets: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """For each run of hashes the minima, then the maxima under all permutations; zeros for an empty run."""
    rng = np.random.default_rng(SEED)
    turn, odd = rng.integers(0, 1 << 63, (2, permutations)).astype(np.uint64)
    out = np.zeros((len(offsets) - 1, 2 * permutations), np.uint64)
    some = np.flatnonzero(np.diff(offsets))
    for p in range(permutations if len(some) else 0):
        h = (hashes ^ turn[p]) * (odd[p] | np.uint64(1))
        out[some, p] = np.minimum.reduceat(h, offsets[some])
        out[some, permutations + p] = np.maximum.reduceat(h, offsets[some])
    return out


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key for each `rows` neighbouring values of a signature, other for each band."""
    n, width = signatures.shape
    bands = signatures.reshape(n, width // rows, rows)
    key = np.tile(np.arange(1, width // rows + 1, dtype=np.uint64), (n, 1))
    for r in range(rows):
        key = (key ^ bands[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """The distinct hashes of each text's shingles, in order, where each text's begin, and a digest of each set (None: empty)."""
    h, offsets = word_shingles(texts, words)
    sets = [np.unique(h[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64), [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]


def linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets, of (node, hashes), are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "left"):
            both = [[np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("left", "right")]
            good = [linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent) for x, y in zip(*both)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda c, name: sets.select(F.col("node").alias(c), F.col("hashes").alias(name))
    return pairs.select("a", "b").join(side("a", "left"), "a").join(side("b", "right"), "b").select("a", "b", "left", "right").mapInArrow(check, "a binary, b binary")


def links_in_place(members: DataFrame, percent: int, permutations: int) -> DataFrame:
    """(a, b): for each shard of (shard, node, size, root, hashes) a spanning forest of the links between nodes of different roots.
    Only pairs are compared of which signatures and sizes do not rule out a link and which are not joined yet."""
    s = percent / 100
    floor = s - SLACK * np.sqrt(s * (1 - s) / (2 * permutations))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _shards(batches, "node", "size", "root", "hashes"):
            if len(rows) < 2:
                continue
            sets = [np.frombuffer(r[3], np.uint64) for r in rows]
            sizes = np.array([len(x) for x in sets], np.int64)
            at = np.concatenate([[0], np.cumsum(sizes)])
            flat = np.concatenate(sets)
            signatures = min_max(flat, at, permutations)
            _, which = np.unique(flat, return_inverse=True)
            mark = np.zeros(int(which.max()) + 1, bool)
            _, group = np.unique(np.array([r[2].hex() for r in rows]), return_inverse=True)
            found = []
            for k in range(1, len(rows)):
                fit = (group[:k] != group[k]) & (100 * np.minimum(sizes[:k], sizes[k]) >= percent * np.maximum(sizes[:k], sizes[k]))
                near = np.flatnonzero(fit)
                near = near[(signatures[near] == signatures[k]).mean(axis=1) >= floor] if len(near) else near
                if not len(near):
                    continue
                mark[which[at[k] : at[k + 1]]] = True
                for j in near.tolist():
                    if group[j] != group[k] and linked(int(mark[which[at[j] : at[j + 1]]].sum()), int(sizes[j]), int(sizes[k]), percent):
                        group[group == group[j]] = group[k]
                        found.append((rows[j][0], rows[k][0]))
                mark[which[at[k] : at[k + 1]]] = False
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.binary()) for i in (0, 1)], names=["a", "b"])

    return members.select("shard", "node", "size", "root", "hashes").repartition("shard").sortWithinPartitions("shard", "node").mapInArrow(search, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 85, permutations: int = PERMUTATIONS, rows: int = ROWS, limit: int = SHARD_LIMIT, few: int = FEW) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of (doc_id, text).

    A text's set has its distinct shingles of `words` words in lower case (A-Z), with fewer words its whole sequence. Texts link where
    100 * intersection >= percent * union; a component is what links reach, its id the smallest doc_id in it (nulls aside; null if it has
    no other), and kept says whether the row's doc_id is that. Null and blank texts have an empty set and link with nothing, so they are
    their own component. Equal sets link. Repeated rows and null doc_ids stay; an empty table gives no rows; columns besides doc_id and
    text are ignored. Two texts at exactly 85 % share no band with a chance of 7 in a million."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "minmax")
    n_bands = 2 * permutations // rows

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=2 << 20):
            h, offsets, digests = shingle_sets(texts_of(batch), words)
            raw, n = band_keys(min_max(h, offsets, permutations), rows).astype("<u8").tobytes(), 8 * n_bands
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("tkey"), pa.array(digests, pa.binary()), pa.array(np.diff(offsets)), pa.array([raw[k * n : (k + 1) * n] for k in range(len(digests))], pa.binary())], names=["doc_id", "tkey", "node", "size", "bands"])

    keyed = pick(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64("text").alias("tkey"))
    prints = scratch.table("prints", keyed.mapInArrow(compute, "doc_id long, tkey long, node binary, size long, bands binary"), "snappy")
    nodes = prints.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("tkey", "doc_id")).alias("of"), F.max("size").alias("size"), F.max("bands").alias("bands"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), "<i8")
            whose = pa.array(np.repeat(np.arange(batch.num_rows), n_bands))
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(batch.column(c).take(whose) for c in ("node", "size", "tkey", "doc_id"))], names=["shard", "node", "size", "tkey", "doc_id"])

    dealt = scratch.table("dealt", nodes.select("node", "size", "of.tkey", "of.doc_id", "bands").mapInArrow(deal, "shard long, node binary, size long, tkey long, doc_id long"), "snappy")
    shared = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = scratch.table("members", dealt.join(shared, "shard"), "snappy")

    # one row of each node, named by its doc_id too, gives its set; a bitmap of fixed size says which, and what it lets through too much
    # only costs time
    marks = bitmap.build(members.select(F.xxhash64("tkey", "doc_id").alias("h")).distinct(), "h", BITMAP_BITS)
    sent = spark.sparkContext.broadcast(marks)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(sent.value, np.uint8)
        for batch in slices(batches, most=2 << 20):
            use = bitmap.test(wanted, batch.column("h").to_numpy().view(np.uint64), BITMAP_BITS)
            if not use.any():
                continue
            h, offsets, digests = shingle_sets(texts_of(batch.filter(pa.array(use))), words)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([h[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())], names=["node", "hashes"])

    sets = scratch.table("sets", keyed.select(F.xxhash64("tkey", "doc_id").alias("h"), "text").mapInArrow(sets_of, "node binary, hashes binary").dropDuplicates(["node"]), "snappy")

    fit = F.expr(f"100 * least(size, other) >= {percent} * greatest(size, other)")
    ordered = (F.least("node", "mate").alias("a"), F.greatest("node", "mate").alias("b"))
    block = F.pmod(F.xxhash64("shard", "node"), F.ceil(F.col("n") / limit)).alias("block")
    blocks = members.select("shard", block, "node", "size")
    heads = blocks.groupBy("shard", "block").agg(F.min(F.struct("node", "size")).alias("x")).select("shard", "block", F.col("x.node").alias("mate"), F.col("x.size").alias("other"))
    first = scratch.table("first", blocks.join(heads, ["shard", "block"]).where((F.col("node") != F.col("mate")) & fit).select(*ordered).distinct(), "snappy")
    joined = components(scratch.table("links", confirmed(first, sets, percent)), Scratch(spark, "minmax_first"))

    rooted = scratch.table("rooted", members.select("shard", "node", "size", "n").join(joined, "node", "left").select("shard", "node", "size", "n", F.coalesce("root", "node").alias("root")), "snappy")
    small = rooted.where(F.col("n") <= few)
    open_ = small.groupBy("shard").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("shard")
    own = small.join(open_, "shard", "left_semi")
    mates = own.select("shard", F.col("node").alias("mate"), F.col("size").alias("other"), F.col("root").alias("their"))
    rest = own.join(mates, "shard").where((F.col("node") < F.col("mate")) & (F.col("root") != F.col("their")) & fit).select(*ordered).distinct().join(first, ["a", "b"], "left_anti")
    more = scratch.table("more", confirmed(rest, sets, percent))
    hot = scratch.table("hot", deal_hot(rooted.where(F.col("n") > few).drop("n"), limit), "snappy")
    if not hot.isEmpty():
        more = more.unionByName(scratch.table("inside", links_in_place(hot.join(sets, "node"), percent, permutations)))
    edges = joined.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
    linked_ = components(edges, Scratch(spark, "minmax_all"))

    of_node = nodes.select("node", "least").join(linked_, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = of_node.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of_node.join(ids, "root").select("node", "component_id")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return prints.select("doc_id", "node", "size").join(named, "node", "left").select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
