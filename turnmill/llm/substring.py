"""Exact removal of word sequences that occur more than once, by super-k-mer partitioning.

Every window of `window` words has a minimiser: the least hash among its runs of `mer` words. Consecutive windows with
the same minimiser make a super-k-mer, which travels as one packed string to the bucket of its minimiser. Equal windows have
equal minimisers, so each bucket counts its windows exactly, by their whole text. Before that, minimisers that occur once in
the corpus are struck out by a bitmap of fixed size; what it lets through too much only costs time."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap
from .common import Scratch, flat_ranges, pick, ship, slices, split_words, texts_of

WINDOW, MER = 35, 8
#: Bits of the bitmap of repeated minimisers: 16 MB, whatever the corpus.
BITMAP_BITS = 27
#: Super-k-mers of one bucket that one task counts; those of a larger bucket are counted window by window.
BUCKET_LIMIT = 2048
PLACE = np.uint64(28)


class Words:
    """The words of some texts, joined by single spaces, with their hashes."""

    def __init__(self, texts: pa.Array):
        self.values, self.at = split_words(texts)
        size = pc.binary_length(self.values).to_numpy(zero_copy_only=False).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(size + 1)])

    def joined(self) -> bytes:
        return b" ".join(self.values.cast(pa.large_binary()).to_pylist())

    def hashes(self) -> np.ndarray:
        coded = self.values.cast(pa.large_binary()).dictionary_encode()
        known = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        return known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else known


def super_kmers(words: Words, window: int = WINDOW, mer: int = MER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """minimiser, text, first window's first word (an index into all words) and number of windows of each super-k-mer."""
    n_words = np.diff(words.at)
    n_windows = np.maximum(n_words - window + 1, 0)
    starts = flat_ranges(words.at[:-1], n_windows)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    w, n = words.hashes(), len(words.values) - mer + 1
    if n >= 1 << int(PLACE):
        raise ValueError(f"a text of {n} words or more is too long: places have {PLACE} bits")
    h = np.zeros(n, np.uint64)
    for j in range(mer):
        h = h * np.uint64(0x100000001B3) + w[j : j + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    # least of the mers in each window, the leftmost of equals: by hash, then place
    least = (h >> PLACE << PLACE) | np.arange(n, dtype=np.uint64)
    span, done = window - mer + 1, 1
    while done * 2 <= span:
        least = np.minimum(least[: len(least) - done], least[done:])
        done *= 2
    if span > done:
        least = np.minimum(least[: len(least) - (span - done)], least[span - done :])
    place = (least[starts] & np.uint64((1 << 28) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(n_words)), n_windows)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return h[place[first]], text[first], starts[first], np.diff(np.append(first, len(starts)))


def repeated_minimisers(docs: DataFrame, window: int, mer: int, bits: int) -> bytes:
    """A bitmap with the bits of all minimisers that occur at two places or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            value, n = np.unique(super_kmers(Words(texts_of(batch)), window, mer)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], names=["h", "n"])

    again = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    return bitmap.build(again, "h", bits)


def _digest(payload: bytes) -> bytes:
    return xxhash.xxh3_128_digest(payload)


def _windows(payload: bytes, n: int, window: int) -> list[bytes]:
    ends = [k for k, c in enumerate(payload) if c == 32]
    begins = [0, *[e + 1 for e in ends]]
    ends.append(len(payload))
    return [payload[begins[i] : ends[i + window - 1]] for i in range(n)]


def duplicated_windows(docs: DataFrame, scratch: Scratch, window: int = WINDOW, mer: int = MER, bits: int = BITMAP_BITS, limit: int = BUCKET_LIMIT) -> DataFrame:
    """(doc_id, tkey, runs): of each text (tkey: its xxhash64) the places of windows that also occur elsewhere, as
    structs of a first window and a mask of the windows from there on."""
    spark = docs.sparkSession
    repeated = spark.sparkContext.broadcast(repeated_minimisers(docs, window, mer, bits))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each super-k-mer. Of equal ones among these texts the first carries the string and their number."""
        marks = np.frombuffer(repeated.value, np.uint8)
        for batch in slices(batches):
            words = Words(texts_of(batch))
            h, text, first, n = super_kmers(words, window, mer)
            use = np.flatnonzero(bitmap.test(marks, h, bits))
            if not len(use):
                continue
            h, text, first, n = h[use], text[use], first[use], n[use]
            whole = words.joined()
            place: dict[bytes, int] = {}
            packed, keys, times = [], [], []
            for a, b in zip(words.begin[first].tolist(), (words.begin[first + n + window - 1] - 1).tolist()):
                p = whole[a:b]
                k = place.setdefault(p, len(keys))
                new = k == len(keys)
                packed.append(p if new else None)
                keys.append(_digest(p) if new else keys[k])
                times.append(1 if new else 0)
                if not new:
                    times[k] += 1
            values = (batch.column("doc_id").cast(pa.int64()).take(pa.array(text)), batch.column("tkey").take(pa.array(text)), pa.array(first - words.at[text]), pa.array(keys, pa.binary()), pa.array(h.view(np.int64)), pa.array(n), pa.array(times, pa.int64()), pa.array(packed, pa.binary()))
            yield pa.RecordBatch.from_arrays(list(values), names=["doc_id", "tkey", "first", "pkey", "h", "n", "times", "payload"])

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by bucket, equal payloads side by side. The bucket's windows are sorted; those that stand there twice make the masks."""
        bucket, held, out = None, [], []

        def close() -> None:
            masks = [0] * len(held)
            ordered = sorted((x, k, i) for k, (p, n, _) in enumerate(held) for i, x in enumerate(_windows(p, n, window)))
            for _, run in itertools.groupby(ordered, key=lambda x: x[0]):
                places = [x[1:] for x in run]
                if len(places) > 1 or held[places[0][0]][2] > 1:
                    for k, i in places:
                        masks[k] |= 1 << i
            out.extend((_digest(held[k][0]), mask) for k, mask in enumerate(masks) if mask)

        def rows() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 2, (pa.binary(), pa.int64()))], names=["pkey", "mask"])
            out.clear()
            return made

        for batch in batches:
            for h, p, n, t in zip(*(batch.column(c).to_pylist() for c in ("h", "payload", "n", "times"))):
                if h != bucket:
                    close()
                    bucket, held = h, []
                if held and held[-1][0] == p:
                    held[-1][2] += t
                    continue
                held.append([p, n, t])
            yield rows()
        close()
        yield rows()

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, n, t in zip(*(batch.column(c).to_pylist() for c in ("payload", "n", "times"))):
                own, key = _windows(p, n, window), _digest(p)
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(x).digest() for x in own], pa.binary()), pa.array([key] * n, pa.binary()), pa.array(range(n), pa.int64()), pa.array([t] * n, pa.int64())], names=["digest", "pkey", "i", "times"])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tkey"))
    pieces = scratch.table("pieces", keyed.mapInArrow(cut, "doc_id long, tkey long, first long, pkey binary, h long, n long, times long, payload binary"))
    packed = pieces.where("payload IS NOT NULL").select("h", "payload", "n", "times")
    # a bucket of many strings is not brought together: its windows are counted one by one, dealt by their digests
    hot = scratch.table("hot", packed.groupBy("h").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > limit).select("h"))
    cool = packed.join(hot, "h", "left_anti")
    masks = scratch.table("verdicts", cool.repartition("h").sortWithinPartitions("h", "payload").mapInArrow(verdicts, "pkey binary, mask long"))
    if not hot.isEmpty():
        single = scratch.table("single", packed.join(hot, "h", "left_semi").mapInArrow(apart, "digest binary, pkey binary, i long, times long"))
        twice = single.groupBy("digest").agg(F.sum("times").alias("n")).where("n > 1").select("digest")
        masks = masks.unionByName(single.join(twice, "digest", "left_semi").select("pkey", "i").distinct().groupBy("pkey").agg(F.sum(F.expr("shiftleft(1L, int(i))")).alias("mask")))
    places = pieces.select("doc_id", "tkey", "first", "pkey")
    hit = places.join(masks, "pkey").select("doc_id", "tkey", F.struct("first", "mask").alias("run"))
    return hit.groupBy("doc_id", "tkey").agg(F.collect_set("run").alias("runs"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, mer: int = MER, bits: int = BITMAP_BITS, limit: int = BUCKET_LIMIT) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) and kept_sha256 for each row of (doc_id, text).

    A word goes if a window of `window` words over it has a sequence of words that starts anywhere else in the corpus, in
    the same text or another; windows are judged on the input. Null and blank texts have no words and kept ''; texts
    shorter than a window keep all. Repeated rows repeat each other's windows, so they lose theirs; null doc_ids stay; an
    empty table gives no rows; columns besides doc_id and text are ignored."""
    ship(docs.sparkSession)
    docs = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = duplicated_windows(docs, Scratch(docs.sparkSession, "substring"), window, mer, bits, limit)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, at = split_words(texts_of(batch))
            edge = np.zeros(len(values) + 1, np.int64)
            for base, runs in zip(at[:-1].tolist(), batch.column("runs").to_pylist()):
                for run in runs or ():
                    first, mask = base + run["first"], run["mask"]
                    while mask:
                        i = (mask & -mask).bit_length() - 1
                        edge[first + i] += 1
                        edge[first + i + window] -= 1
                        mask &= mask - 1
            keep = np.cumsum(edge)[:-1] == 0
            left = np.concatenate([[0], np.cumsum(keep)])[at]
            rest = values.filter(pa.array(keep)).cast(pa.large_binary())
            whole = b" ".join(rest.to_pylist())
            begin = np.concatenate([[0], np.cumsum(pc.binary_length(rest).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])[left].tolist()
            kept = [whole[a : max(a, b - 1)] for a, b in zip(begin, begin[1:])]
            n = np.diff(at)
            sha = [hashlib.sha256(x).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(n - np.diff(left)), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tkey"))
    mine = found.select(F.col("doc_id").alias("d"), F.col("tkey").alias("t"), "runs")
    both = keyed.join(mine, F.expr("doc_id <=> d AND tkey = t"), "left").select("doc_id", "text", "runs")
    return both.mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
