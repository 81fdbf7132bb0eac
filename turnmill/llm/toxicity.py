"""Toxicity scores from a bag of subword embeddings under a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its hashed character n-grams and of itself, so a misspelling that was never
seen shares most of its vector with the word. A window's vector is the mean over its words; the softmax scores windows,
and a document is as toxic as its most toxic window, which one insult in a long text can't hide in. Labels are of
documents: a first fit gives every window its document's label, a second keeps of toxic documents the windows found.

All labelled rows train. They are dealt to shards of bounded size, each shard trains a model, and the models' shares of the
logit, in which a document's windows are linear, are averaged."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Scratch, flat_ranges, give_back, pick, ship, slices, split_words, texts_of


@dataclass(frozen=True)
class Settings:
    #: Bytes of text that one model is trained on at a time, and of a piece of a longer text.
    shard_bytes: int = 5 << 20
    piece_bytes: int = 1 << 19
    #: Rows of each class that a shard has at least: where a class is rarer, its rows go to several shards.
    least_rows: int = 16
    #: The bounds of sample(): rows of each class, and bytes of whole texts.
    rows_each: int = 2000
    class_bytes: int = 6 << 20
    window: int = 4
    buckets: int = 1 << 17
    dims: int = 2
    ngrams: tuple[int, ...] = (3, 4, 5)
    #: Steps of a fit at least, and words of a step.
    updates: int = 48
    step_words: int = 100_000
    rate: float = 0.3
    decay: float = 2e-6
    #: Logits are calibrated on parts of the training rows, so many, each by a model that has not seen it.
    calibrate: int = 3
    #: A subword that fewer of the training documents have says nothing: it would only learn these by heart.
    least_documents: int = 6
    seed: int = 7


def subwords(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's n-grams (with marks at its borders) and of itself, word after word, and where each begins."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    code = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(size)
    begins = ends - size
    counts = [np.maximum(size - n + 1, 0) for n in s.ngrams]
    at = np.concatenate([[0], np.cumsum(sum(counts) + 1)])
    out = np.empty(at[-1], np.int32)
    prime = np.uint64(0x9E3779B97F4A7C15)
    bucket = lambda h: ((h >> np.uint64(20)) % np.uint64(s.buckets)).astype(np.int32)
    to = at[:-1]
    for n, count in zip(s.ngrams, counts):
        first = flat_ranges(begins, count)
        h = np.full(len(first), n, np.uint64)
        for j in range(n):
            h = (h ^ code[first + j]) * prime
            h ^= h >> np.uint64(29)
        out[flat_ranges(to, count)] = bucket(h)
        to = to + count
    whole = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    out[to] = bucket(whole)
    return out, at


def _words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-case words, the index of each word of the texts among them, and where each text's words begin."""
    values, at = split_words(texts)
    coded = pc.utf8_lower(values).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), at


def window_starts(at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each window begins, in words, and the text it is of. A text's last window may be short."""
    n = -(-np.diff(at) // window)
    first = flat_ranges(np.zeros(len(n), np.int64), n) * window
    text = np.repeat(np.arange(len(n)), n)
    return first + at[:-1][text], text


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Adam:
    """Steps of the columns that a batch touches, by moments of their own and the number of batches that touched them."""

    def __init__(self, shape, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape, np.float32), np.zeros(shape, np.float32), np.zeros(shape[-1], np.int32), rate

    def step(self, x: np.ndarray, g: np.ndarray, on: np.ndarray | slice = slice(None)) -> None:
        self.t[on] += 1
        m, v, t = self.m[..., on], self.v[..., on], self.t[on]
        m = m + 0.1 * (g - m)
        v = v + 0.01 * (g * g - v)
        self.m[..., on], self.v[..., on] = m, v
        x[..., on] -= self.rate * (m / (1 - np.power(0.9, t))) / (np.sqrt(v / (1 - np.power(0.99, t))) + 1e-8)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _documents(bucket: np.ndarray, word_at: np.ndarray, which: np.ndarray, at: np.ndarray, s: Settings, most: int = 1 << 20) -> np.ndarray:
    """How many documents have each bucket. As many documents are looked at together as have `most` subwords."""
    n_words, size = len(word_at) - 1, np.diff(word_at)
    load = np.concatenate([[0], np.cumsum(size[which])])[at]
    count, a = np.zeros(s.buckets, np.int64), 0
    while a < len(at) - 1:
        b = max(a + 1, int(np.searchsorted(load, load[a] + most, side="right")) - 1)
        doc = np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))
        pairs = _distinct(doc * n_words + which[at[a] : at[b]])  # a document's distinct words
        word = pairs % n_words
        seen = _distinct(np.repeat(pairs // n_words, size[word]) * s.buckets + bucket[flat_ranges(word_at[word], size[word])])
        count += np.bincount(seen % s.buckets, minlength=s.buckets)
        a = b
    return count


def _fit(batches: list[tuple], n_rows: int, s: Settings) -> tuple[np.ndarray, float]:
    """Embeddings (n_rows of them and one of zeros) and softmax weights by gradients through both means, as each row's share of the
    logit and the bias. A batch: rows of its words' subwords, where a word's begin and their number, the words of its
    windows, where a window's begin and their number, labels, weights."""
    rng = np.random.default_rng(s.seed)
    table = (rng.uniform(-1, 1, (s.dims, n_rows + 1)) / s.dims).astype(np.float32)
    table[:, -1] = 0
    softmax, bias = rng.normal(0, 0.1, (s.dims, 2)).astype(np.float32), np.zeros(2, np.float32)
    steps = [Adam(x.shape, s.rate) for x in (table, softmax, bias)]
    touched = [np.flatnonzero(np.bincount(b[0], minlength=n_rows + 1)[:-1]) for b in batches]
    for _ in range(-(-s.updates // len(batches))):
        for on, (row, word_at, n_sub, word, bag_at, n_word, label, weight) in zip(touched, batches):
            mean = np.empty((len(bag_at), s.dims), np.float32)
            for k in range(s.dims):
                vectors = np.add.reduceat(table[k][row], word_at) / n_sub
                mean[:, k] = np.add.reduceat(vectors[word], bag_at) / n_word
            z = mean @ softmax + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(label)), label] -= 1
            g = p * weight[:, None]
            g_mean = (g @ softmax.T) / n_word[:, None]
            g_table = np.empty((s.dims, len(on)), np.float32)
            for k in range(s.dims):
                g_word = np.bincount(word, np.repeat(g_mean[:, k], n_word), len(n_sub)) / n_sub
                g_table[k] = np.bincount(row, np.repeat(g_word, n_sub), n_rows + 1)[on] + s.decay * table[k][on]
            steps[1].step(softmax, mean.T @ g + s.decay * softmax)
            steps[2].step(bias, g.sum(axis=0))
            steps[0].step(table, g_table, on)
    return (softmax[:, 1] - softmax[:, 0]) @ table[:, :-1], float(bias[1] - bias[0])


class Model:
    """Scalars only: a bucket's share of the logit, the bias, and the calibration of a document's largest logit."""

    def __init__(self, share: np.ndarray, bias: float, slope: float, offset: float, settings: Settings):
        self.share, self.bias, self.slope, self.offset, self.settings = share.astype(np.float32), bias, slope, offset, settings

    def window_logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The logit of each window, the text it is of, and the number of words of each text."""
        words, which, at = _words(texts)
        begin, text = window_starts(at, self.settings.window)
        if not len(which):
            return np.zeros(0), text, np.diff(at)
        bucket, word_at = subwords(words, self.settings)
        of_word = np.add.reduceat(self.share[bucket].astype(np.float64), word_at[:-1]) / np.diff(word_at)
        size = np.diff(np.append(begin, len(which)))
        return np.add.reduceat(of_word[which], begin) / size + self.bias, text, np.diff(at)

    def largest(self, texts: pa.Array) -> np.ndarray:
        z, text, _ = self.window_logits(texts)
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, text, z)
        out[np.isinf(out)] = self.bias  # no words
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return _sigmoid(self.slope * self.largest(texts) + self.offset)

    def dump(self) -> tuple[bytes, str]:
        return self.share.tobytes(), json.dumps([self.bias, self.slope, self.offset])

    @staticmethod
    def load(share: bytes, rest: str, settings: Settings) -> Model:
        return Model(np.frombuffer(share, np.float32), *json.loads(rest), settings)


def _calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit by Newton steps."""
    x, w = np.stack([z, np.ones_like(z)], axis=1), np.zeros(2)
    for _ in range(25):
        p = _sigmoid(x @ w)
        g = x.T @ ((p - y) * weight) + 1e-3 * w
        h = (x * (p * (1 - p) * weight)[:, None]).T @ x + 1e-3 * np.eye(2)
        w -= np.linalg.solve(h, g)
    return float(w[0]), float(w[1])


def _learn(texts: pa.Array, y: np.ndarray, s: Settings, allowed: np.ndarray | None = None) -> Model:
    """A model without calibration; one of zeros if the texts have one class or no words. allowed: the buckets that enough documents
    have, if the texts are not all there are."""
    words, which, at = _words(texts)
    if not len(which) or y.min() == y.max():
        return Model(np.zeros(s.buckets), 0.0, 1.0, 0.0, s)
    begin, text = window_starts(at, s.window)
    size = np.diff(np.append(begin, len(which)))
    bucket, word_at = subwords(words, s)
    del words
    n_sub = np.diff(word_at)
    if allowed is None:
        allowed = _documents(bucket, word_at, which, at, s) >= s.least_documents
    # only the buckets that are used and may speak have rows; the last row stays zero for the rest
    kept = np.flatnonzero(allowed)
    row = np.full(s.buckets, len(kept), np.int32)
    row[kept] = np.arange(len(kept))

    def batch(window: np.ndarray, weight: np.ndarray) -> tuple:
        n_word = size[window]
        word = which[flat_ranges(begin[window], n_word)]
        used = np.flatnonzero(np.bincount(word, minlength=len(n_sub)))
        place = np.zeros(len(n_sub), np.int32)
        place[used] = np.arange(len(used))
        first = lambda n: (np.cumsum(n) - n).astype(np.int32)
        return row[bucket[flat_ranges(word_at[used], n_sub[used])]], first(n_sub[used]), n_sub[used], place[word], first(n_word), n_word.astype(np.int32), y[text[window]].astype(np.int32), weight.astype(np.float32)

    def fit(keep: np.ndarray) -> Model:
        window = np.flatnonzero(keep)
        label = y[text[window]]
        n = max(1, int(size[window].sum()) // s.step_words)
        weight = np.where(label == 1, 0.5 * n / max(1, label.sum()), 0.5 * n / max(1, (1 - label).sum()))
        share, bias = _fit([batch(*x) for x in zip(np.array_split(window, n), np.array_split(weight, n))], len(kept), s)
        out = np.zeros(s.buckets, np.float32)
        out[kept] = share
        return Model(out, bias, 1.0, 0.0, s)

    model = fit(np.ones(len(begin), bool))
    of_word = np.add.reduceat(model.share[bucket].astype(np.float64), word_at[:-1]) / n_sub
    z = np.add.reduceat(of_word[which], begin) / size + model.bias
    calm = z[y[text] == 0]
    found = (y[text] == 1) & (z > np.quantile(calm, 0.995)) if len(calm) else np.zeros(len(z), bool)
    return fit((y[text] == 0) | found) if found.any() else model


def _one_sided(texts: pa.Array, y: np.ndarray) -> bool:
    return not len(y) or y.min() == y.max() or not pc.any(pc.match_substring_regex(texts, r"[^\x20\x09-\x0D]")).as_py()


def learn_part(texts: pa.Array, labels: np.ndarray, s: Settings, part: int) -> tuple[Model, np.ndarray, np.ndarray]:
    """For part < s.calibrate: a model that has not seen this part, the part's largest logits, and its labels. For part ==
    s.calibrate: the model of all."""
    y = np.asarray(labels, np.float64)
    if _one_sided(texts, y):
        return Model(np.zeros(s.buckets), 0.0, 0.0, 30.0 if len(y) and y.min() == 1 else -30.0, s), np.zeros(0), y
    own = np.arange(len(y)) % s.calibrate == part
    model = _learn(texts.filter(pa.array(~own)), y[~own], s)
    return model, model.largest(texts.filter(pa.array(own))) if own.any() else np.zeros(0), y[own]


def calibrated(model: Model, z: np.ndarray, y: np.ndarray) -> Model:
    """The model with the slope and offset that logits of unseen texts ask for."""
    if not len(z):
        return model
    slope, offset = _calibrate(z, y, np.ones(len(y)))
    if slope <= 0:  # logits that tell nothing leave the share of label 1
        slope, offset = 0.0, float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    return Model(model.share, model.bias, slope, offset, model.settings)


def train(texts: pa.Array, labels: np.ndarray, settings: Settings = Settings()) -> Model:
    """A model of the texts and their labels (0, 1). With one class only, or no words, every score is that class's."""
    parts = [learn_part(texts, labels, settings, k) for k in range(settings.calibrate + 1)]
    return calibrated(parts[-1][0], *(np.concatenate([p[k] for p in parts[:-1]]) for k in (1, 2)))


def held_out(doc_id, modulus: int = 5, remainder: int = 0):
    """Whether crc32 of the doc_id as text leaves the remainder; a null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def _known(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labels that may be learnt from. Several labels of a doc_id count as the greatest."""
    return pick(labels, "doc_id", "toxic").where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def sample(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(text, toxic, h): a bounded sample of labelled rows for a quick look, rows held out left aside; fit() trains on all. Of each class the
    settings.rows_each rows of least hash are looked at in that order, and those stay whose texts fit in what is left of settings.class_bytes, so a
    long text takes the place of no other. Several labels of a doc_id count as the greatest; equal rows count once, near copies each."""
    known = _known(labels)
    some = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.rows_each) for c in (0, 1)]
    rows = pick(docs, "doc_id", "text").join(F.broadcast(some[0].unionByName(some[1])), "doc_id").withColumn("h", F.xxhash64("doc_id", "text"))  # at most 2 * rows_each doc_ids
    # a doc_id may stand for many rows; only hashes and lengths of those looked at go to the driver, 2 * rows_each at most
    heads = rows.select("toxic", "h", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).distinct()
    first = [heads.where(F.col("toxic") == c).orderBy("h", "doc_id").limit(settings.rows_each) for c in (0, 1)]
    left, chosen = [settings.class_bytes] * 2, []
    for r in sorted(first[0].unionByName(first[1]).collect(), key=lambda r: (r["h"], r["doc_id"])):
        if r["size"] <= left[r["toxic"]]:
            left[r["toxic"]] -= r["size"]
            chosen.append((r["h"], r["doc_id"]))
    keys = F.broadcast(docs.sparkSession.createDataFrame(chosen, "h long, doc_id long"))
    return rows.join(keys, ["h", "doc_id"], "left_semi").dropDuplicates(["h", "doc_id"]).select("text", "toxic", "h")


#: Bits of the set of labelled doc_ids, which keeps most other texts out of the shuffle.
ID_BITS = 25


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, h, doc_id, size): all labelled rows, rows held out left aside. Equal rows count once, near copies each."""
    known = _known(labels)
    bit = lambda c: F.xxhash64(c).bitwiseAND((1 << ID_BITS) - 1)
    ids = known.select(bit("doc_id").alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit)").alias("place")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("map"))
    rows = pick(docs, "doc_id", "text").withColumn("bit", bit("doc_id"))
    place, byte = F.expr("bitmap_bucket_number(bit)"), F.expr("conv(hex(substring(map, cast(bitmap_bit_position(bit) div 8 as int) + 1, 1)), 16, 10)").cast("int")
    rows = rows.withColumn("place", place).join(F.broadcast(ids), "place").where(byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(bit) % 8 as int))")) != 0)  # 4 MB at most
    rows = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).join(known.hint("shuffle_hash"), "doc_id").dropDuplicates(["doc_id", "h"])
    return rows.select(F.coalesce("text", F.lit("")).alias("text"), "toxic", "h", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))


def _frequent(rows: DataFrame, s: Settings) -> np.ndarray:
    """Which buckets enough of the rows' texts have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(s.buckets, np.int64)
        for batch in slices(batches, most=CHUNK_BYTES // 4):
            words, which, at = _words(texts_of(batch))
            count += _documents(*subwords(words, s), which, at, s)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], names=["bucket", "n"])

    found = rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= s.least_documents).select("bucket")
    out = np.zeros(s.buckets, bool)
    out[[r[0] for r in found.collect()]] = True  # s.buckets at most
    return out


def _pieces(rows: DataFrame, s: Settings) -> DataFrame:
    """The rows with long texts cut where windows begin. A window is trained on with its document's label, so this changes nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for r in range(batch.num_rows):
                own = batch.slice(r, 1)
                values, at = split_words(texts_of(own))
                ends = np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
                a, k = 0, 0
                while a < len(values):
                    b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + s.piece_bytes, side="right"))
                    b = min(len(values), max(a + s.window, a + (b - a) // s.window * s.window))
                    text = pa.array([" ".join(values[a:b].to_pylist())], pa.string())
                    yield pa.RecordBatch.from_arrays([text, *(own.column(c) for c in ("toxic", "h", "doc_id")), pa.array([k], pa.int32())], names=["text", "toxic", "h", "doc_id", "piece"])
                    a, k = b, k + 1

    names = ("text", "toxic", "h", "doc_id")
    whole = rows.where(F.col("size") <= s.piece_bytes).select(*names, F.lit(0).alias("piece"))
    return whole.unionByName(rows.where(F.col("size") > s.piece_bytes).select(*names).mapInArrow(run, "text string, toxic int, h long, doc_id long, piece int"))


#: Buckets that a row of a model's sums has.
SUM_ROW = 2048


def _averages(rows: DataFrame, counts: dict[int, tuple[int, int]], s: Settings) -> list[Model]:
    """For each part of the rows (by h) the average of the models of shards of the other parts, and then that of all. Each row is in a
    shard of its own part, each shard in one task."""
    allowed = np.packbits(_frequent(rows, s))
    each = max(1, -(-sum(size for _, size in counts.values()) // (s.calibrate * s.shard_bytes)))
    # of a rare class every row goes to so many shards of its part
    copies = {c: min(each, -(-s.least_rows * s.calibrate * each // n)) for c, (n, _) in counts.items()}
    part = F.pmod("h", F.lit(s.calibrate)).cast("int")
    nth = F.explode(F.sequence(F.lit(0), F.when(F.col("toxic") == 1, copies[1] - 1).otherwise(copies[0] - 1)))
    dealt = _pieces(rows, s).withColumn("nth", nth)
    dealt = dealt.withColumn("shard", part + s.calibrate * F.pmod(F.xxhash64("h", "piece") + F.col("nth"), F.lit(each)).cast("int"))
    shards = s.calibrate * each
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "h", "doc_id", "piece").select("shard", "text", "toxic")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usable, got, at = np.unpackbits(allowed)[: s.buckets].astype(bool), [], None

        def made() -> Iterator[pa.RecordBatch]:
            texts, y = pa.concat_arrays([g[0] for g in got]), np.concatenate([g[1] for g in got]).astype(np.float64)
            got.clear()
            model = _learn(texts, y, s, usable)
            give_back()
            n = s.buckets // SUM_ROW
            share = [x.tobytes() for x in model.share.reshape(n, SUM_ROW)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, at), pa.int32()), pa.array(range(n), pa.int32()), pa.array(share, pa.binary()), pa.array(np.full(n, model.bias))], names=["shard", "place", "share", "bias"])

        for b in slices(batches):
            for shard in sorted(set(b.column("shard").to_pylist())):
                if got and shard != at:
                    yield from made()
                own, at = b.filter(pc.equal(b.column("shard"), shard)), shard
                got.append((texts_of(own), own.column("toxic").to_numpy(zero_copy_only=False)))
        if got:
            yield from made()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for b in batches:
            for shard, place, share, bias in zip(*(c.to_pylist() for c in b.columns)):
                x = sums.setdefault((shard % s.calibrate, place), [np.zeros(SUM_ROW), 0.0, 0])
                x[0] += np.frombuffer(share, np.float32)
                x[1] += bias
                x[2] += 1
        for (own, place), (share, bias, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([place], pa.int32()), pa.array([share.tobytes()], pa.binary()), pa.array([bias]), pa.array([n], pa.int64())], names=["own", "place", "share", "bias", "n"])

    models = dealt.mapInArrow(learn, "shard int, place int, share binary, bias double")
    summed = models.repartition("place").sortWithinPartitions("place", "shard").mapInArrow(total, "own int, place int, share binary, bias double, n long")
    share, bias, n = np.zeros((s.calibrate, s.buckets // SUM_ROW, SUM_ROW)), np.zeros(s.calibrate), np.zeros(s.calibrate)
    for r in summed.collect():  # s.calibrate models
        share[r["own"], r["place"]], bias[r["own"]], n[r["own"]] = np.frombuffer(r["share"]), r["bias"], r["n"]
    share = share.reshape(s.calibrate, s.buckets)
    others = [np.arange(s.calibrate) != k for k in range(s.calibrate + 1)]
    return [Model(share[o].sum(axis=0) / max(1, n[o].sum()), float(bias[o].sum() / max(1, n[o].sum())), 1.0, 0.0, s) for o in others]


def _calibrated(rows: DataFrame, models: list[Model], scratch: Scratch, s: Settings) -> Model:
    """As calibrated(): Newton steps whose sums Spark takes over the logits of all rows, each by the models that have not seen it."""
    dumped = [m.dump() for m in models[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unseen = [Model.load(*d, s) for d in dumped]
        for b in slices(batches):
            part = b.column("h").to_numpy() % s.calibrate
            for k in np.unique(part):
                own = b.filter(pa.array(part == k))
                yield pa.RecordBatch.from_arrays([pa.array(unseen[k].largest(texts_of(own))), own.column("toxic")], names=["z", "y"])

    logits = scratch.table("logits", rows.select("text", "toxic", "h").mapInArrow(run, "z double, y int"))
    w, z, y = np.zeros(2), F.col("z"), F.col("y")
    for _ in range(25):
        at = F.least(F.greatest(z * float(w[0]) + float(w[1]), F.lit(-40.0)), F.lit(40.0))
        p = 1 / (1 + F.exp(-at))
        sums = logits.select(z, (p - y).alias("g"), (p * (1 - p)).alias("h"), y).agg(F.sum(z * F.col("g")), F.sum("g"), F.sum(z * z * F.col("h")), F.sum(z * F.col("h")), F.sum("h"), F.avg(y.cast("double"))).first()
        step = np.linalg.solve(np.array([[sums[2], sums[3]], [sums[3], sums[4]]]) + 1e-3 * np.eye(2), np.array(sums[:2]) + 1e-3 * w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    slope, offset = (float(f"{x:.6g}") for x in w)  # sums come in any order, so a repeated run may differ behind that
    if slope <= 0:  # logits that tell nothing leave the share of label 1
        slope, offset = 0.0, float(np.log((sums[5] + 1e-9) / (1 - sums[5] + 1e-9)))
    return Model(models[-1].share, models[-1].bias, slope, offset, s)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Trains on all labelled rows of (doc_id, text) with labels (doc_id, toxic). What fits in a shard is trained on whole, beside the models
    that calibrate it; else models of shards are averaged, and the parts of the rows are calibrated by each other's."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    rows = scratch.table("labelled", labelled(docs, labels))
    counts = {r["toxic"]: (r["n"], r["size"]) for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()}
    if len(counts) < 2:  # no labelled row, or one class
        return train(pa.array([""] * len(counts), pa.large_string()), np.array(list(counts)), settings)
    if sum(size for _, size in counts.values()) > settings.shard_bytes:
        return _calibrated(rows, _averages(rows, counts, settings), scratch, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {}
        for b in batches:
            for part in set(b.column("part").to_pylist()):
                own = b.filter(pc.equal(b.column("part"), part))
                got.setdefault(part, []).append((texts_of(own), own.column("toxic").to_numpy(zero_copy_only=False)))
        for part in sorted(got):
            rows = got.pop(part)
            model, z, y = learn_part(pa.concat_arrays([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), settings, part)
            share, rest = model.dump() if part == settings.calibrate else (None, None)
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([share], pa.binary()), pa.array([rest], pa.string()), pa.array([z], pa.list_(pa.float64())), pa.array([y], pa.list_(pa.float64()))], names=["part", "share", "rest", "z", "y"])

    # two parts share a task, one after the other; rows come in an order of their own, so that a repeated run trains the same models
    each = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(settings.calibrate)))).repartitionByRange(max(1, settings.calibrate), "part").sortWithinPartitions("part", "h", "text")
    found = each.select("text", "toxic", "part").mapInArrow(run, "part int, share binary, rest string, z array<double>, y array<double>").collect()
    found.sort(key=lambda r: r["part"])  # a model and as many logits as a shard has rows
    z, y = (np.array([x for r in found[:-1] for x in r[k]]) for k in ("z", "y"))
    return calibrated(Model.load(found[-1]["share"], found[-1]["rest"], settings), z, y)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5 on) for each row of (doc_id, text); only the text is looked at. A
    null or blank text is scored as a window without words. Null doc_ids and repeated rows stay; other columns are
    ignored; an empty table gives no rows."""
    ship(docs.sparkSession)
    share, rest = model.dump()
    settings = model.settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.load(share, rest, settings)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(model.scores(texts_of(batch)))], names=["doc_id", "score"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score_held_out(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """score() with held_out, by a model that saw no held-out label. Without any label every score is 0."""
    return score(docs, fit(docs, labels, settings)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all their columns, whose text scores below the threshold. Nothing is shuffled. Null and blank texts are
    scored as a window without words; without any label all rows stay."""
    share, rest = (model := fit(docs, labels, settings)).dump()
    settings = model.settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.load(share, rest, settings)
        for batch in slices(batches):
            yield batch.filter(pa.array(model.scores(texts_of(batch)) < threshold))

    return docs.mapInArrow(run, docs.schema)
