"""SimHash near-duplicates by BK-trees over shards of fingerprints.

Two fingerprints that differ in at most `radius` bits agree on one of radius + 1 bands whole, so they share a shard (band
number, its bits). Each shard gets a BK-tree, children keyed by their Hamming distance to the parent; a search follows
only edges within the radius of the distance to the node. A shard too large for one tree is dealt again by bands of the
remaining bits, which loses no pair. From each task only a spanning forest of the links leaves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii, pick, ship, slices, split_words, texts_of

SEED = 42
#: A larger shard is dealt again by further bits.
SHARD_LIMIT = 2048


def shingle_hashes(texts: pa.Array, words: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of consecutive words, repeats included, and where each text's begin. A text with fewer
    words has its whole sequence as the only one; one without words has none."""
    values, at = split_words(texts)
    n_words = np.diff(at)
    size = pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    joined = b" ".join(values.cast(pa.large_binary()).to_pylist())
    count = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    offsets = np.concatenate([[0], np.cumsum(count)])
    first = np.arange(offsets[-1]) + np.repeat(at[:-1] - offsets[:-1], count)
    last = first + np.repeat(np.minimum(n_words, words), count)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(begin[first].tolist(), (begin[last] - 1).tolist())), np.uint64, len(first))
    return hashes, offsets


def majority_bits(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each run of hashes the bits set in over half of them; 0 for an empty run."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    n = np.diff(offsets)
    some = np.flatnonzero(n)
    if len(some):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_ = np.add.reduceat(bits, offsets[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(set_ * 2 > n[some, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fingerprint (64 bits as a signed long) for each row of (doc_id, text); null or blank texts have 0."""
    ship(docs.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=2 << 20):
            found = majority_bits(*shingle_hashes(lower_ascii(texts_of(batch)), words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"])

    return pick(docs, "doc_id", "text").mapInArrow(compute, "doc_id long, fingerprint long")


class BKTree:
    """Of integers under Hamming distance. A node is [value, {distance to it: child}]."""

    def __init__(self):
        self.root: list | None = None

    def within(self, value: int, radius: int) -> list[int]:
        found, open_ = [], [self.root] if self.root else []
        while open_:
            node = open_.pop()
            d = (node[0] ^ value).bit_count()
            if d <= radius:
                found.append(node[0])
            children = node[1]
            if children:
                for k in range(max(1, d - radius), d + radius + 1):
                    if k in children:
                        open_.append(children[k])
        return found

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while d := (node[0] ^ value).bit_count():
            if d not in node[1]:
                node[1][d] = [value, {}]
                return
            node = node[1][d]


class Forest:
    """Union-find; a set's root is its smallest member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, path = self.up, []
        while (y := up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            up[p] = x
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            a, b = min(a, b), max(a, b)
            self.up[b] = a
            self.up.setdefault(a, a)


def _band(bits: Column, width: int, bands: int) -> Column:
    """Structs (band, its bits, the other bits closed up) for each band of the lower `width` bits."""
    step = -(-width // bands)
    out = []
    for b in range(bands):
        lo, hi = b * step, min(width, (b + 1) * step)
        above = F.shiftleft(F.shiftrightunsigned(bits, hi), lo) if hi < 64 else F.lit(0)
        out.append(F.struct(F.lit(b).alias("band"), F.shiftrightunsigned(bits, lo).bitwiseAND((1 << hi - lo) - 1).alias("own"), bits.bitwiseAND((1 << lo) - 1).bitwiseOR(above).alias("rest")))
    return F.array(*out)


def shards(prints: DataFrame, radius: int, scratch: Scratch, limit: int = SHARD_LIMIT) -> DataFrame:
    """(shard, fingerprint), so that any two fingerprints within the radius meet in a shard. `shard` is the path of bands."""
    bands, width = radius + 1, 64
    step = -(-width // bands)

    def deal(rows: DataFrame, rest: str, width: int) -> DataFrame:
        x = rows.select(*(["shard"] if "shard" in rows.columns else [F.lit("").alias("shard")]), "fingerprint", F.explode(_band(F.col(rest), width, bands)).alias("x"))
        return x.select(F.concat_ws(".", F.nullif("shard", F.lit("")), F.col("x.band"), F.col("x.own")).alias("shard"), "fingerprint", F.col("x.rest").alias("rest"))

    rows = deal(prints, "fingerprint", width)
    done = None
    while True:
        width -= step
        step = -(-width // bands)
        if width <= 2 * bands or step < 4:
            return rows.select("shard", "fingerprint") if done is None else done.unionByName(rows.select("shard", "fingerprint"))
        # few: each holds over `limit` rows
        hot = scratch.table(f"hot{width}", rows.groupBy("shard").count().where(F.col("count") > limit).select("shard"))
        cool = rows.join(hot, "shard", "left_anti").select("shard", "fingerprint")
        done = cool if done is None else done.unionByName(cool)
        if hot.isEmpty():
            return done
        rows = deal(rows.join(hot, "shard", "left_semi"), "rest", width)


def links(sharded: DataFrame, radius: int) -> DataFrame:
    """(a, b), a > b: a spanning forest, for each task, of all links within its shards."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, shard, members = Forest(), None, []

        def close() -> None:
            if len(members) < 2:
                return
            tree = BKTree()
            for value in members:
                for other in tree.within(value, radius):
                    forest.join(value, other)
                tree.add(value)

        for batch in batches:
            for name, value in zip(batch.column("shard").to_pylist(), batch.column("fingerprint").to_numpy().view(np.uint64).tolist()):
                if name != shard:
                    close()
                    shard, members = name, []
                members.append(value)
        close()
        pairs = [(x, r) for x in list(forest.up) if (r := forest.root(x)) != x]
        a, b = (np.array(x, np.uint64).view(np.int64) for x in (zip(*pairs) if pairs else ([], [])))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return sharded.repartition("shard").sortWithinPartitions("shard").mapInArrow(search, "a long, b long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the component's smallest node. Large-star and small-star
    steps alternate until nothing changes. Minima are partially aggregated and joins may be split, so no node's edges
    have to meet in one task; each round is a written table."""
    edges = scratch.table("edges0", edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen, k = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # large-star keeps a link from each node to a smaller one, so each node's least neighbour now lies below it
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        k += 1
        edges = scratch.table(f"edges{k}", small)
        scratch.drop(f"edges{k - 1}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = now


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, limit: int = SHARD_LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of (doc_id, text).

    Fingerprints are linked at `radius` differing bits or fewer; a component is what links reach, its id the smallest
    doc_id in it (nulls aside; null if it has no other). Null and blank texts have fingerprint 0, which links like any other.
    Equal texts share a fingerprint and so a component. Repeated rows and null doc_ids stay; an empty table gives no rows;
    columns besides doc_id and text are ignored."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.table("prints", fingerprints(docs, words))
    distinct = scratch.table("distinct", prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    linked = components(links(shards(distinct, radius, scratch, limit), radius), scratch)
    of_print = distinct.join(linked, distinct.fingerprint == linked.node, "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    ids = of_print.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of_print.join(ids, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


#: Shingles of the texts of a block, which one task holds twice at a time.
BLOCK_LOAD = 1 << 21
#: Texts of a shard up to which its candidates are written as pairs.
FEW = 32
#: 64-bit tables of the wide fingerprint; bands of least hashes, and hashes of a band.
TABLES, BANDS, ROWS = 8, 16, 4


def word_shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every shingle of consecutive words in lower case, made of hashes of its words, repeats included, and where each
    text's begin; a text with fewer words has its whole sequence as the only one, one without words has none."""
    values, at = split_words(lower_ascii(texts))
    n_words = np.diff(at)
    coded = values.cast(pa.large_binary()).dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    w = known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.uint64)
    count = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    offsets = np.concatenate([[0], np.cumsum(count)])
    first = np.arange(offsets[-1]) + np.repeat(at[:-1] - offsets[:-1], count)
    size = np.repeat(np.minimum(n_words, words), count)
    h = size.astype(np.uint64)
    for j in range(words):
        own = size > j
        h[own] = (h[own] ^ w[first[own] + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h, offsets


def min_hash_keys(hashes: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row of keys of each run of hashes, one for each band. A key is made of the least hashes under `rows` functions, so that two
    runs share it with the probability of their Jaccard similarity to that power. Empty runs have keys of their own."""
    rng = np.random.default_rng(SEED)
    turn, odd = rng.integers(0, 1 << 63, (2, bands, rows)).astype(np.uint64)
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(offsets) - 1, 1))
    some = np.flatnonzero(np.diff(offsets))
    for b in range(bands):
        for r in range(rows if len(some) else 0):
            least = np.minimum.reduceat((hashes ^ turn[b, r]) * (odd[b, r] | np.uint64(1)), offsets[some])
            key = (out[some, b] ^ least) * np.uint64(0x9E3779B97F4A7C15)
            out[some, b] = key ^ key >> np.uint64(29)
    return out


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Of each text the distinct hashes of its shingles, in order."""
    h, offsets = word_shingles(texts, words)
    return [np.unique(h[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def wide_fingerprints(hashes: np.ndarray, offsets: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """A row of `tables` fingerprints of each run of hashes, every one with hashes of its own of the same shingles."""
    out = np.zeros((len(offsets) - 1, tables), np.uint64)
    for t in range(tables):
        g = (hashes + np.uint64(2 * t + 1)) * np.uint64(0xD6E8FEB86659FD93 + 2 * t)
        g ^= g >> np.uint64(32)
        g *= np.uint64(0xFF51AFD7ED558CCD)
        g ^= g >> np.uint64(29)
        out[:, t] = majority_bits(g, offsets)
    return out


def similarity_radius(similarity: float, bits: int, slack: float = 3.3) -> int:
    """Differing bits expected of two sets of equal size at this Jaccard similarity, plus slack standard deviations. Sets of
    other sizes with this similarity differ in fewer."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * (p + slack * np.sqrt(p * (1 - p) / bits)))


def _shards(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list[list]]:
    """The rows of each shard, whose rows lie side by side, and after each batch an empty list: time to give out what was found."""
    shard, members = None, []
    for batch in batches:
        for name, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", *columns))):
            if name != shard:
                if members:
                    yield members
                shard, members = name, []
            members.append(row)
        yield []
    if members:
        yield members


class Prints:
    """A BK-tree of wide fingerprints, and who has each."""

    def __init__(self):
        self.tree, self.at = BKTree(), {}

    def add(self, value: int, who: tuple) -> None:
        if value not in self.at:
            self.tree.add(value)
        self.at.setdefault(value, []).append(who)

    def near(self, value: int, radius: int) -> list[tuple[int, list[tuple]]]:
        """(differing bits, who), the nearest first."""
        return sorted((((value ^ v).bit_count(), self.at[v]) for v in self.tree.within(value, radius)), key=lambda x: x[0])


def candidates(members: DataFrame, radius: int, similarity: float, every: bool) -> DataFrame:
    """(a, b), a < b, of the nodes that a BK-tree finds within the radius in a shard, less those whose sizes rule the similarity
    out. Of members (shard, node, size, print, root): with `every`, all pairs of different roots; else of each node the nearest
    other one."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []

        def pairs() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
            found.clear()
            return out

        for rows in _shards(batches, "node", "size", "print", "root"):
            prints = Prints()
            rows = [(node, size, int.from_bytes(raw, "little"), root) for node, size, raw, root in rows] if len(rows) > 1 else []
            for node, size, value, root in rows:
                prints.add(value, (node, size, root))
            for node, size, value, root in rows:
                fit = lambda m, size=size: min(m, size) >= similarity * max(m, size)
                near = (x for _, who in prints.near(value, radius) for x, m, r in who if x != node and fit(m) and not (every and (r == root or x > node)))
                found.extend((min(x, node), max(x, node)) for x in (near if every else [next(near, None)]) if x is not None)
                if len(found) > 50_000:
                    yield pairs()
            if not rows and found:
                yield pairs()
        yield pairs()

    return members.select("shard", "node", "size", "print", "root").repartition("shard").sortWithinPartitions("shard", "node").mapInArrow(search, "a long, b long").distinct()


def links_by_sets(members: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(a, b), a > b: a spanning forest, for each shard, of the links between nodes of different roots. Members (shard, node, size,
    print, root, hashes) bring their whole sets of shingles, so that what a BK-tree finds is confirmed where it is found and the
    pairs of a large group are never written down."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _shards(batches, "node", "size", "print", "root", "hashes"):
            if len(rows) < 2:
                continue
            sets = [np.frombuffer(r[4], np.uint64) for r in rows]
            sizes = np.array([len(x) for x in sets], np.int64)
            _, which = np.unique(np.concatenate(sets), return_inverse=True)
            at = np.concatenate([[0], np.cumsum(sizes)])
            full = np.flatnonzero(sizes)
            mark = np.zeros(int(which.max()) + 1 if len(which) else 1, np.int32)
            prints, forest, found = Prints(), Forest(), []
            for k, (_, size, raw, root, _) in enumerate(rows):
                value = int.from_bytes(raw, "little")
                near = np.array([j for _, who in prints.near(value, radius) for j, m, r in who if min(m, size) >= similarity * max(m, size) and forest.root(r) != forest.root(root)], np.int64)
                if len(near):
                    own = which[at[k] : at[k + 1]]
                    mark[own] = 1
                    common = np.zeros(len(rows), np.int64)
                    common[full] = np.add.reduceat(mark[which], at[full]) if len(full) else 0
                    mark[own] = 0
                    for j in near[common[near] >= similarity * (sizes[near] + sizes[k] - common[near]) - 1e-9].tolist():
                        if forest.root(rows[j][3]) != forest.root(root):
                            forest.join(rows[j][3], root)
                            found.append((rows[k][0], rows[j][0]))
                prints.add(value, (k, size, root))
            yield pa.RecordBatch.from_arrays([pa.array([f(p) for p in found], pa.int64()) for f in (max, min)], names=["a", "b"])

    return members.repartition("shard").sortWithinPartitions("shard", "node").mapInArrow(search, "a long, b long").distinct()


def confirmed(pairs: DataFrame, keyed: DataFrame, scratch: Scratch, name: str, words: int, similarity: float) -> DataFrame:
    """The pairs of (a, b) whose texts have this Jaccard similarity or more, by their whole sets of shingles. Two texts without
    words are alike. keyed has tkey and text."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("tkey")).distinct()
    texts = scratch.table(f"texts_{name}", keyed.select("tkey", "text").join(need, "tkey", "left_semi").dropDuplicates(["tkey"]))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "left", 1 << 20):
            left, right = (shingle_sets(texts_of(batch, c), words) for c in ("left", "right"))
            same = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)]
            good = [n >= similarity * (len(x) + len(y) - n) - 1e-9 for n, x, y in zip(same, left, right)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(texts.select(F.col("tkey").alias("a"), F.col("text").alias("left")), "a").join(texts.select(F.col("tkey").alias("b"), F.col("text").alias("right")), "b")
    return scratch.table(name, both.select("a", "b", "left", "right").mapInArrow(check, "a long, b long"))


def deal_hot(rows: DataFrame, limit: int) -> DataFrame:
    """The rows (shard, node, root, and others) of shards with more than one root, `shard` naming a part of the shard. Any two rows
    of a shard with different roots meet in a part. A shard of over `limit` rows, or BLOCK_LOAD of their sizes, is cut into blocks of
    about as many, and there is a part for each two blocks, but none for two of its commonest root: of these each meets only the others."""
    load = F.sum("size") if "size" in rows.columns else F.lit(0)
    counts = rows.groupBy("shard", "root").agg(F.count(F.lit(1)).alias("c"), load.alias("load"))
    open_ = counts.groupBy("shard").agg(F.count(F.lit(1)).alias("roots"), F.max_by("root", "c").alias("major"), F.max("c").alias("same"), F.sum("c").alias("n"), F.max_by("load", "c").alias("same_load"), F.sum("load").alias("load")).where("roots > 1")
    blocks = lambda n, load: F.ceil(F.greatest(n / limit, load / BLOCK_LOAD))
    few, many = blocks(F.col("n") - F.col("same"), F.col("load") - F.col("same_load")), blocks(F.col("same"), F.col("same_load"))
    x = rows.join(open_.withColumns({"few": few, "many": many}), "shard").withColumn("other", F.col("root") != F.col("major"))
    x = x.withColumn("block", F.pmod(F.xxhash64("shard", "node"), F.when(F.col("other"), F.col("few")).otherwise(F.col("many"))))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    part = lambda kind, i, j: F.concat_ws(".", "shard", F.lit(kind), i, j)
    among = F.transform(upto("few"), lambda k: part("u", F.least("block", k), F.greatest("block", k)))
    across = F.transform(upto("many"), lambda k: part("m", F.col("block"), k))
    parts = F.when((F.col("n") <= limit) & (F.col("load") <= BLOCK_LOAD), F.array(F.col("shard").cast("string"))).when(F.col("other"), F.concat(among, across)).otherwise(F.transform(upto("few"), lambda k: part("m", k, F.col("block"))))
    return x.withColumn("part", F.explode(parts)).select(F.col("part").alias("shard"), *[c for c in rows.columns if c != "shard"])


def told_apart(prints: DataFrame, keyed: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Both with a tkey that unequal texts do not share: where a tkey has several values of `other`, a second hash, all but the least
    get a tkey of their own. Such rows are about as rare as hashes of 64 bits meet."""
    met = scratch.table("met", prints.groupBy("tkey").agg(F.min("other").alias("least"), F.max("other").alias("most")).where("least <> most").select("tkey", "least"))
    if met.isEmpty():
        return prints, keyed
    own = F.when(F.col("other") != F.col("least"), F.xxhash64("other", "tkey")).otherwise(F.col("tkey"))
    again = lambda df: df.join(met, "tkey", "left").withColumn("tkey", own).drop("least")
    return scratch.table("told_apart", again(prints), "snappy"), again(keyed)


def similar_texts(docs: DataFrame, scratch: Scratch, words: int, similarity: float, limit: int = SHARD_LIMIT, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tkey) of each row of (doc_id, text), tkey being the text's hash, and (node, root) of all tkeys linked.

    Texts meet in a shard if they share a band of least hashes; a BK-tree there finds those whose wide fingerprints differ by no
    more than the similarity lets expect, with room. Candidates are confirmed on the whole sets of shingles: first each text's
    nearest one, then all between texts that this has not joined yet, since links inside a group change nothing. The first step
    cuts a shard of over `limit` texts into blocks; in the second all its pairs that are not joined meet, in shards of over `few`
    texts without leaving their task."""
    ship(docs.sparkSession)
    radius = similarity_radius(similarity, TABLES * 64)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            sets = shingle_sets(texts_of(batch), words)
            sizes = np.array([len(x) for x in sets], np.int64)
            h, offsets = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)])
            raw = np.concatenate([wide_fingerprints(h, offsets), min_hash_keys(h, offsets, BANDS, ROWS)], axis=1).astype("<u8").tobytes()
            n = 8 * (TABLES + BANDS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("tkey"), batch.column("other"), pa.array(sizes), pa.array([raw[k * n : (k + 1) * n] for k in range(len(sets))], pa.binary())], names=["doc_id", "tkey", "other", "size", "print"])

    text = F.coalesce("text", F.lit(""))
    keyed = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64(text).alias("tkey"), F.xxhash64(F.lit(1), text).alias("other"), "text")
    prints = scratch.table("prints", keyed.mapInArrow(compute, "doc_id long, tkey long, other long, size long, print binary"), "snappy")
    prints, keyed = told_apart(prints, keyed, scratch)
    distinct = prints.groupBy("tkey").agg(F.max("size").alias("size"), F.max("print").alias("print"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("print").to_pylist()
            keys = np.frombuffer(b"".join(x[8 * TABLES :] for x in raw), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("tkey").take(pa.array(np.repeat(np.arange(len(raw)), BANDS)))], names=["shard", "node"])

    # most texts share no band with any other, so fingerprints travel only to shards of two or more
    dealt = scratch.table("dealt", distinct.select("tkey", "print").mapInArrow(deal, "shard long, node long"))
    shared = scratch.table("shared", dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    head = distinct.select(F.col("tkey").alias("node"), "size", F.substring("print", 1, 8 * TABLES).alias("print"))
    members = scratch.table("members", dealt.join(shared, "shard").join(head, "node"), "snappy")
    none = F.lit(0).cast("long").alias("root")
    block = F.concat_ws(".", "shard", F.pmod(F.xxhash64("shard", "node"), F.ceil(F.col("n") / limit))).alias("shard")
    first = scratch.table("first", candidates(members.select(block, "node", "size", "print", none), radius, similarity, False))
    joined = components(confirmed(first, keyed, scratch, "links", words, similarity), Scratch(docs.sparkSession, "neardup_first"))
    rooted = members.join(joined.withColumnRenamed("node", "tkey"), F.col("node") == F.col("tkey"), "left").select("shard", "node", "size", "print", "n", F.coalesce("root", "node").alias("root"))
    # a shard with one group is done. In a small one a node has few others, and pairs are confirmed as before; ...
    rest = scratch.table("rest", candidates(rooted.where(F.col("n") <= few).drop("n"), radius, similarity, True).join(first, ["a", "b"], "left_anti"))
    more = confirmed(rest, keyed, scratch, "more", words, similarity)
    # ... in a large one they are confirmed in place, by the texts' sets of shingles
    hot = scratch.table("hot", deal_hot(rooted.where(F.col("n") > few).drop("n"), limit), "snappy")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            made = [x.tobytes() for x in shingle_sets(texts_of(batch), words)]
            yield pa.RecordBatch.from_arrays([batch.column("tkey"), pa.array(made, pa.binary())], names=["node", "hashes"])

    if not hot.isEmpty():
        texts = keyed.select("tkey", "text").join(hot.select(F.col("node").alias("tkey")).distinct(), "tkey", "left_semi").dropDuplicates(["tkey"])
        known = scratch.table("sets", texts.mapInArrow(sets, "node long, hashes binary"), "snappy")
        more = more.unionByName(scratch.table("inside", links_by_sets(hot.join(known, "node"), radius, similarity)))
    edges = joined.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more.select("a", "b"))
    return prints.select("doc_id", "tkey", "other"), components(edges, scratch)


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, limit: int = SHARD_LIMIT) -> DataFrame:
    """The rows of docs, all their columns, with one of each group of near-duplicate texts: that of least doc_id (nulls
    last), of these least text hash. Near duplicates have shingles of `words` words of this Jaccard similarity or more:
    their wide SimHash finds them, their shingles confirm it. Null and blank texts make a group of their own, as do any equal texts. Of rows equal in
    doc_id and text that of least hash of all its columns stays. An empty table gives no rows."""
    scratch = Scratch(docs.sparkSession, "neardup")
    keys, linked = similar_texts(docs, scratch, words, similarity, limit)
    of = keys.join(linked, keys.tkey == linked.node, "left").select("doc_id", "tkey", "other", F.coalesce("root", "tkey").alias("root"))
    first = of.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc"), "tkey", "other")).alias("x")).select("x.none", "x.doc", "x.other")
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"), F.xxhash64(F.lit(1), text).alias("other"))
    row_key = ["none", "doc", "other"]  # none is null, so join and window need one order
    whole_row = F.xxhash64(*[F.to_json(F.col("row")[f.name]) if "map<" in f.dataType.simpleString() else F.col("row")[f.name] for f in docs.schema.fields])
    same = Window.partitionBy(*row_key).orderBy(whole_row)
    return whole.join(first, row_key, "left_semi").withColumn("n", F.row_number().over(same)).where("n = 1").select(*[F.col("row")[c].alias(c) for c in docs.columns])
