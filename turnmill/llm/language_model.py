"""Log-likelihood of documents under a gated recurrent network with a class-factored softmax, in numpy.

The output first chooses a class, then a word in it. Frequent words lie in classes of like total weight and are chosen by a
softmax on the state, and they grow in number with the vocabulary; all other words lie in classes by their last letters and are
chosen by their add-one share of the class, counted over the whole training corpus, with one share for words never seen. So every
word has its place, and probabilities of all words sum to one. Training is truncated backpropagation with the state carried on;
scoring carries a document's state from its first token to its last. The network trains on all training documents: shards of them
refine a common first model in parallel and their parameters are averaged by tokens."""

from __future__ import annotations

import heapq
import itertools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, flat_ranges, lower_ascii, pick, ship, slices, split_words, texts_of
from .toxicity import held_out

#: The end of a document as a word; no word of a text is empty.
END = ""


@dataclass(frozen=True)
class Settings:
    #: Words chosen by the network: so many, or as many times the root of the number of distinct words, whichever is more.
    words: int = 1024
    words_a_root: float = 1.5
    #: Classes of these for each root of their number, and classes of all other words by their last letters.
    classes_a_root: float = 0.75
    endings: int = 24
    state: int = 16
    #: Words whose counts every worker holds: the most frequent one in so many, the former at most. Counts of all other
    #: words are joined.
    head: int = 1 << 18
    head_one_in: int = 8
    #: Training tokens of a shard, about; one of over twice as many is cut.
    shard_tokens: int = 1_200_000
    #: Passes over the first shard, by which the common first model is made, and their rate.
    epochs: int = 3
    rate: float = 0.03
    #: Side by side and steps of one update. A small shard has fewer lanes, so that it has about so many updates.
    lanes: int = 512
    span: int = 16
    updates: int = 128
    seed: int = 11
    #: Documents scored side by side.
    score_lanes: int = 1024


def ending(words: pa.Array, n: int) -> np.ndarray:
    """The class of each word by its last two characters, of which there are few different ones."""
    last = pc.utf8_slice_codeunits(words, -2).dictionary_encode()
    of = np.array([zlib.crc32(x.encode()) % n for x in last.dictionary.to_pylist()], np.int64)
    return of[last.indices.to_numpy()]


class Vocabulary:
    """Places: 0.. the network's words by falling count, then the classes of other words by ending."""

    def __init__(self, words: list[str], counts: list[int], s: Settings):
        self.words, self.place, self.s = words, {w: i for i, w in enumerate(words)}, s
        share = np.sqrt(np.maximum(np.array(counts, np.float64), 1))
        # classes are runs of words of about equal sum of root counts
        wanted = max(1, round(s.classes_a_root * math.sqrt(len(words))))
        cut = np.floor(np.cumsum(share) / max(share.sum(), 1) * wanted * (1 - 1e-9)).astype(np.int64) if words else np.zeros(0, np.int64)
        _, self.word_class = np.unique(cut, return_inverse=True)
        self.n_classes = int(self.word_class.max()) + 1 if words else 0
        self.class_start = np.searchsorted(self.word_class, np.arange(self.n_classes + 1))
        self.size = len(words) + s.endings
        #: The class of each place.
        self.class_of = np.concatenate([self.word_class, self.n_classes + np.arange(s.endings)]).astype(np.int16)

    def ids(self, words: pa.Array) -> np.ndarray:
        at = pc.fill_null(pc.index_in(words, value_set=pa.array(self.words, words.type)), -1).to_numpy(zero_copy_only=False)
        return np.where(at < 0, len(self.words) + ending(words, self.s.endings), at).astype(np.int32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


#: exp() of a larger number may overflow in a sum of 32-bit floats.
LARGE = 60.0


def _with_one(h: np.ndarray) -> np.ndarray:
    """States side by side, and a row of ones below that takes the biases."""
    out = np.ones((h.shape[1] + 1, len(h)), np.float32)
    out[:-1] = h.T
    return out


def _logits(weights: np.ndarray, states: np.ndarray, large: bool) -> np.ndarray:
    """A column of logits for each state. Where they may be large, the greatest of each column is taken off: neither shares nor
    their logarithms change."""
    out = weights @ states
    if large:
        out -= out.max(axis=0)
    return out


def _less_own(logits: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """The softmax of each column less one at its own entry, over n, in place."""
    np.exp(logits, out=logits)
    logits *= (1 / n) / (np.ones(len(logits), np.float32) @ logits)
    logits[own, np.arange(len(own))] -= 1 / n
    return logits


def _log_share(logits: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The logarithm of one entry of the softmax of each column."""
    picked = logits[own, np.arange(len(own))]
    np.exp(logits, out=logits)
    return picked - np.log(np.ones(len(logits), np.float32) @ logits)


class Network:
    """A GRU. A word's input vector is its part of the three gates; the output is a softmax over classes and one over the words of
    the class."""

    def __init__(self, v: Vocabulary, counts: np.ndarray | None = None, parameters: np.ndarray | None = None):
        self.v, s = v, v.s
        h, c = s.state, v.n_classes + s.endings
        self.shapes = {"in": (v.size, 3 * h), "u": (h, 3 * h), "wc": (c, h), "bc": (c,), "ww": (len(v.words), h), "bw": (len(v.words),)}
        self.n = sum(math.prod(x) for x in self.shapes.values())
        if parameters is None:
            rng = np.random.default_rng(s.seed)
            scale = {"in": 0.3, "u": 1 / math.sqrt(h), "wc": 0.05, "ww": 0.05}
            parameters = np.concatenate([rng.standard_normal(math.prod(x)) * scale.get(k, 0) for k, x in self.shapes.items()])
        self.all = np.array(parameters, np.float32)
        self.p = self.views(self.all)
        if counts is not None:  # start from the shares of classes and of words in them
            share = np.log(counts + 1.0)
            self.p["bw"][:] = share[: len(v.words)]
            total = np.bincount(v.class_of, counts + 1.0, c)
            self.p["bc"][:] = np.log(total / total.sum())

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, x in self.shapes.items():
            out[k] = flat[at : at + math.prod(x)].reshape(x)
            at += math.prod(x)
        return out

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple:
        """x: the input's part of the gates. Returns the new state and what the way back needs. It is quick where a number of all
        lanes lies in one piece, so that both are transposed arrays."""
        n, x, h = h.shape[1], x.T, h.T
        g = self.p["u"].T @ h
        zr = _sigmoid(x[: 2 * n] + g[: 2 * n])
        z, r, um = zr[:n], zr[n:], g[2 * n :]
        m = r * um
        m += x[2 * n :]
        np.tanh(m, out=m)
        new = h - m
        new *= z
        new += m
        return new.T, z.T, r.T, m.T, um.T

    def _by_class(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The class of each id, an order by class, and where the tokens of each class of network words begin there."""
        cls = self.v.class_of[ids]
        order = np.argsort(cls, kind="stable")
        return cls, order, np.searchsorted(cls[order], np.arange(self.v.n_classes + 1))

    def _output(self, h: np.ndarray) -> tuple[np.ndarray, bool, np.ndarray, np.ndarray]:
        """Weights and biases in one array, of classes and of words, and which of them may give large logits for these states:
        the classes, and each class's words."""
        most = np.append(np.full(h.shape[1], max(1.0, float(np.abs(h).max(initial=0))), np.float32), np.float32(1))
        classes, words = (np.column_stack([self.p["w" + k], self.p["b" + k]]) for k in "cw")
        inside = np.maximum.reduceat(np.abs(words) @ most, self.v.class_start[:-1]) if len(words) else np.zeros(0)
        return classes, bool((np.abs(classes) @ most).max() > LARGE), words, inside > LARGE

    def log_probabilities(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural logarithms of the class, and for the network's words of the word in it."""
        v = self.v
        cls, order, edge = self._by_class(ids)
        classes, large, words, inner = self._output(h)
        states = _with_one(h)
        out = _log_share(_logits(classes, states, large), cls)
        states, word = states.take(order, axis=1, mode="clip"), ids[order]
        inside = np.zeros(len(ids), np.float32)
        for c in range(v.n_classes):
            a, b, lo, hi = edge[c], edge[c + 1], v.class_start[c], v.class_start[c + 1]
            if a < b and hi - lo > 1:
                inside[a:b] = _log_share(_logits(words[lo:hi], states[:, a:b], inner[c]), word[a:b] - lo)
        out[order] += inside
        return out

    def gradients(self, h: np.ndarray, ids: np.ndarray, g: dict) -> np.ndarray:
        """Of the mean negative log probability, into g; returns the gradient of the states."""
        v, n = self.v, len(ids)
        cls, order, edge = self._by_class(ids)
        classes, large, words, inner = self._output(h)
        states = _with_one(h)
        p = _less_own(_logits(classes, states, large), cls, n)
        by = p @ states.T
        g["wc"][:], g["bc"][:] = by[:, :-1], by[:, -1]
        dh = self.p["wc"].T @ p
        states, word = states.take(order, axis=1, mode="clip"), ids[order]
        inside = np.zeros_like(dh)
        for c in range(v.n_classes):
            a, b, lo, hi = edge[c], edge[c + 1], v.class_start[c], v.class_start[c + 1]
            if a < b and hi - lo > 1:
                own = states[:, a:b]
                q = _less_own(_logits(words[lo:hi], own, inner[c]), word[a:b] - lo, n)
                by = q @ own.T
                g["ww"][lo:hi], g["bw"][lo:hi] = by[:, :-1], by[:, -1]
                np.matmul(self.p["ww"][lo:hi].T, q, out=inside[:, a:b])
        back = np.empty_like(order)
        back[order] = np.arange(n)
        dh += inside.take(back, axis=1, mode="clip")
        return dh.T

    def span(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h: np.ndarray, grad: np.ndarray) -> np.ndarray:
        """Gradients of one span of steps (inputs x, targets y, both steps by lanes) from the states h, into grad; returns the states
        after it. A state starts anew where `fresh`."""
        steps, lanes = x.shape
        n = h.shape[1]
        g = self.views(grad)
        live, gates = (~fresh).astype(np.float32), np.empty((3 * n, steps, lanes), np.float32)
        before, z, r, m, um, states = (np.empty((n, steps, lanes), np.float32) for _ in range(6))
        h = h.T
        for k in range(steps):
            gates[:, k] = self.p["in"].take(x[k], axis=0).T
            np.multiply(h, live[k], out=before[:, k])
            h, *rest = (a.T for a in self.step(gates[:, k].T, before[:, k].T))
            states[:, k] = h
            for kept, a in zip((z, r, m, um), rest, strict=True):
                kept[:, k] = a
        dall = self.gradients(states.reshape(n, -1).T, y.ravel(), g).T.reshape(n, steps, lanes)
        # what does not depend on the steps behind is worked out for all steps at once
        by_z = before - m
        by_m = m
        by_m *= m
        np.subtract(1, by_m, out=by_m)
        left = 1 - z
        by_m *= left
        by_z *= z
        by_z *= left
        by_r = um
        by_r *= r
        np.subtract(1, r, out=left)
        by_r *= left
        back = np.empty((3 * n, steps, lanes), np.float32)
        dh, u = np.zeros((n, lanes), np.float32), self.p["u"]
        for k in range(steps - 1, -1, -1):
            dh += dall[:, k]
            dm = gates[2 * n :, k]
            np.multiply(dh, by_m[:, k], out=dm)
            np.multiply(dh, by_z[:, k], out=back[:n, k])
            np.multiply(dm, by_r[:, k], out=back[n : 2 * n, k])
            np.multiply(dm, r[:, k], out=back[2 * n :, k])
            dh *= z[:, k]
            dh += u @ back[:, k]
            dh *= live[k]
        g["u"][:] = before.reshape(n, -1) @ back.reshape(3 * n, -1).T
        gates[: 2 * n] = back[: 2 * n]
        flat = x.ravel().astype(np.uint16 if self.v.size < 1 << 16 else np.int32)  # short numbers are sorted by their digits
        order = np.argsort(flat, kind="stable")
        found = flat[order]
        first = np.concatenate([[0], np.flatnonzero(found[1:] != found[:-1]) + 1])
        g["in"][:] = 0
        g["in"][found[first]] = np.add.reduceat(gates.reshape(3 * n, -1).take(order, axis=1, mode="clip"), first, axis=1).T
        return h.T

    def train(self, docs: list[np.ndarray], epochs: int, rate: float) -> None:
        """On documents of ids (each with its end), by truncated backpropagation through spans of steps, the states carried on."""
        s, end = self.v.s, self.v.place.get(END, 0)
        if not docs:
            return
        size = sum(map(len, docs))
        lanes = max(1, min(s.lanes, size // (s.span * s.updates)))
        long = -(-size // lanes)
        m1, m2, grad, t = np.zeros(self.n, np.float32), np.zeros(self.n, np.float32), np.zeros(self.n, np.float32), 0
        rng = np.random.default_rng(s.seed)
        total = epochs * -(-long // s.span)
        for _ in range(epochs):
            flat = np.concatenate([docs[i] for i in rng.permutation(len(docs))]).astype(np.int32)
            grid = np.ascontiguousarray(np.resize(flat, long * lanes).reshape(lanes, long).T)  # the last lane ends with the first tokens again
            before = np.concatenate([np.full((1, lanes), end, np.int32), grid[:-1]])
            h = np.zeros((lanes, s.state), np.float32)
            for a in range(0, long, s.span):
                x = before[a : a + s.span]
                grad[:] = 0
                h = self.span(x, grid[a : a + s.span], x == end, h, grad)
                length = math.sqrt(float(grad @ grad))
                if length > 1:
                    grad /= length
                t += 1
                m1 *= 0.9
                m1 += 0.1 * grad
                grad *= grad
                grad *= 0.005
                m2 *= 0.995
                m2 += grad
                now = rate * max(0.1, 1 - t / total)
                np.multiply(m2, 1 / (1 - 0.995**t), out=grad)
                np.sqrt(grad, out=grad)
                grad += 1e-6
                np.divide(m1, grad, out=grad)
                grad *= now / (1 - 0.9**t)
                self.all -= grad

    def score(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural log probabilities (see log_probabilities) summed over each document ids[at[i]:at[i + 1]]. Documents lie
        one after another on lanes, the longest lanes first, so that each step takes the lanes still at work."""
        s, n = self.v.s, self.v.s.state
        size = np.diff(at)
        lanes = min(s.score_lanes, len(size))
        order: list[list[int]] = [[] for _ in range(lanes)]
        heap = [(0, k) for k in range(lanes)]
        for d in np.argsort(-size, kind="stable").tolist():
            w, k = heapq.heappop(heap)
            order[k].append(d)
            heapq.heappush(heap, (w + int(size[d]), k))
        load = np.array([sum(int(size[d]) for d in x) for x in order], np.int64)
        rank = np.argsort(-load, kind="stable")
        docs = np.array([d for k in rank.tolist() for d in order[k]], np.int64)
        lane_at, lengths = np.cumsum(load[rank]) - load[rank], load[rank]
        # step after step the lanes still at work
        active = np.searchsorted(-lengths, -np.arange(lengths[0] if lanes else 0), side="left")
        edge = np.concatenate([[0], np.cumsum(active)])
        where = lane_at[flat_ranges(np.zeros(len(active), np.int64), active)]
        where += np.repeat(np.arange(len(active)), active)
        first = np.zeros(len(where), bool)
        first[(np.cumsum(size[docs]) - size[docs])[size[docs] > 0]] = True
        live = (~first[where]).astype(np.float32)
        place = flat_ranges(at[docs], size[docs])[where]  # in ids; lanes hold one document after another
        target = ids[place]
        source = np.where(live > 0, ids[place - 1], self.v.place.get(END, 0))
        doc_of = np.repeat(docs.astype(np.int32), size[docs])[where]
        del where, first, place
        h = np.zeros((n, lanes), np.float32)
        out = np.zeros(len(size))
        a = 0
        while a < len(active):
            b = min(len(active), max(a + 1, int(np.searchsorted(edge, edge[a] + 16_384))))
            block = slice(edge[a], edge[b])
            gates = np.ascontiguousarray(self.p["in"].take(source[block], axis=0).T)
            states = np.empty((n, gates.shape[1]), np.float32)
            for x, y in itertools.pairwise((edge[a : b + 1] - edge[a]).tolist()):
                h = h[:, : y - x] * live[edge[a] + x : edge[a] + y]
                h = self.step(gates[:, x:y].T, h.T)[0].T
                states[:, x:y] = h
            out += np.bincount(doc_of[block], self.log_probabilities(states.T, target[block]), len(size))
            a = b
        return out


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words (the end last), the index of each token among them, and where each text's tokens begin."""
    values, at = split_words(lower_ascii(texts))
    coded = values.dictionary_encode()
    words, n = coded.dictionary, len(at) - 1
    out = np.full(len(values) + n, len(words), np.int32)
    body = np.ones(len(out), bool)
    body[at[1:] + np.arange(n)] = False
    out[body] = coded.indices.to_numpy(zero_copy_only=False)
    return pa.concat_arrays([words, pa.array([END], words.type)]), out, at + np.arange(n + 1)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, lower-cased, with the end of each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=8 << 20):
            words, which, _ = tokens_of(texts_of(batch))
            n = np.bincount(which, minlength=len(words))
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(n)], names=["word", "n"])

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dealt(training: DataFrame, n_tokens: int, s: Settings) -> tuple[DataFrame, int]:
    """(shard, h, text) of all training rows, and the number of shards."""
    shards = max(1, math.ceil(n_tokens / s.shard_tokens))
    rows = training.select(F.xxhash64("doc_id", "text").alias("h"), "text")
    return rows.select(F.pmod("h", F.lit(shards)).cast("long").alias("shard"), "h", "text"), shards


def by_shard(rows: DataFrame, n: int) -> DataFrame:
    """In n parts that hold equally many shards, give or take one, in order."""
    return rows.repartitionById(n, F.col("shard").cast("int")).sortWithinPartitions("shard", "h", "text")


def learner(words: list[str], counts: np.ndarray, s: Settings, first: np.ndarray | None, epochs: int, rate: float, one: bool = False):
    """A function of batches (shard, h, text) in order of shards: (weight, parameters), the number of tokens and the sum of the
    parameters (as bytes of doubles) that the shards come to from the first ones, times their tokens. A shard of over twice the
    tokens, be it by one text or by many equal rows, is trained as several. With `one` only the first of all trains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary(words, counts[: len(words)].tolist(), s)
        total, weight, docs, held, shard = 0.0, 0, [], 0, None

        def close() -> None:
            nonlocal total, weight, docs, held
            if held and not (one and weight):
                net = Network(own, counts, first)
                net.train(docs, epochs, rate)
                total, weight = total + net.all.astype(np.float64) * held, weight + held
            docs, held = [], 0

        for batch in slices(batches, most=8 << 20):
            found, which, at = tokens_of(texts_of(batch))
            ids = own.ids(found)[which]
            for k, name in enumerate(batch.column("shard").to_pylist()):
                if name != shard:
                    close()
                    shard = name
                doc = ids[at[k] : at[k + 1]]
                while len(doc):
                    piece, doc = doc[: 2 * s.shard_tokens - held], doc[2 * s.shard_tokens - held :]
                    docs.append(piece)
                    held += len(piece)
                    if held == 2 * s.shard_tokens:
                        close()
        close()
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([weight], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["weight", "parameters"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of the sums of rows (weight, parameters)."""
    weight, total = 0, 0.0
    for batch in batches:
        for w, raw in zip(batch.column("weight").to_pylist(), batch.column("parameters").to_pylist()):
            weight, total = weight + w, total + np.frombuffer(raw)
    if weight:
        yield pa.RecordBatch.from_arrays([pa.array([weight], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["weight", "parameters"])


def train(training: DataFrame, v: Vocabulary, counts: np.ndarray, n_tokens: int, scratch: Scratch) -> np.ndarray:
    """Parameters of a network. A first model trains on one shard; all shards then refine it, and the mean of their parameters by
    tokens, summed up in two steps, is the result."""
    s = v.s
    rows, shards = dealt(training, n_tokens, s)
    sent = training.sparkSession.sparkContext.broadcast((v.words, counts))

    def learn(first: np.ndarray | None, epochs: int, rate: float, one: bool):
        return lambda batches: learner(*sent.value, s, first, epochs, rate, one)(batches)

    def mean(df: DataFrame) -> np.ndarray | None:
        made = df.collect()  # a row for each task of the last step
        return sum(np.frombuffer(r["parameters"]) for r in made) / sum(r["weight"] for r in made) if made else None

    kind = "weight long, parameters binary"
    start = mean(by_shard(rows.where("shard = 0"), 1).mapInArrow(learn(None, s.epochs, s.rate, True), kind))
    start = Network(v, counts).all if start is None else start.astype(np.float32)
    refined = scratch.table("refined", by_shard(rows, min(shards, 4096)).mapInArrow(learn(start, 1, s.rate / 3, False), kind))
    done = mean(refined.repartition(8).mapInArrow(_summed, kind))
    return start if done is None else done.astype(np.float32)


def score_documents(docs: DataFrame, s: Settings = Settings(), modulus: int = 7, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of (doc_id, text).

    Rows whose crc32(doc_id as text) leaves the remainder, or whose doc_id is null, are held out; all others train. A null or
    empty text is its end alone. Repeated rows get equal scores and count as often as they occur. Without any training
    row every token is unknown. An empty table gives no rows; other columns are ignored. Texts of any length are scored whole."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "lm")
    docs = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id"), modulus, remainder).alias("held_out"))
    training = docs.where(~F.col("held_out"))
    counted = scratch.table("counts", count_words(training))
    n_train, n_types = (x or 0 for x in counted.agg(F.sum("n"), F.count(F.lit(1))).first())
    # bounded: the head's words by count, and the network's first among them
    n_words = max(s.words, int(s.words_a_root * math.sqrt(n_types)))
    head = counted.orderBy(F.desc("n"), "word").limit(max(2 * n_words, min(s.head, n_types // s.head_one_in)))
    head = scratch.table("head", head)
    top = head.orderBy((F.col("word") != END), F.desc("n"), "word").limit(n_words).collect()
    v = Vocabulary([r["word"] for r in top], [r["n"] for r in top], s)
    network_words = spark.createDataFrame([(r["word"],) for r in top], "word string")
    rest = counted.join(F.broadcast(network_words), "word", "left_anti").groupBy((F.crc32(F.right("word", F.lit(2)).cast("binary")) % s.endings).alias("e")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect()
    tokens, types = np.zeros(s.endings, np.int64), np.zeros(s.endings, np.int64)
    for r in rest:
        tokens[r["e"]], types[r["e"]] = r["n"], r["types"]
    counts = np.concatenate([np.array([r["n"] for r in top], np.float64), tokens])
    parameters = train(training, v, counts, n_train, scratch)
    arrow = head.toArrow().combine_chunks()
    head_words, head_counts = arrow.column("word").combine_chunks(), arrow.column("n").to_numpy().astype(np.int64)
    sent = spark.sparkContext.broadcast((v.words, counts, parameters, head_words, head_counts, tokens, types))
    least = n_train + n_types + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each document, and one for each of its words outside the head with the times it occurs."""
        words, counts, parameters, head_words, head_counts, tokens, types = sent.value
        v = Vocabulary(words, counts[: len(words)].tolist(), s)
        net = Network(v, parameters=parameters)
        lg = np.log10
        share = np.concatenate([np.zeros(len(words)), lg(tokens + types + 1.0)])
        for batch in slices(batches, most=12 << 20):  # the more texts, the more lanes beside the longest one
            found, which, at = tokens_of(texts_of(batch))
            ids = v.ids(found)
            near = pc.fill_null(pc.index_in(found.cast(head_words.type), value_set=head_words), -1).to_numpy(zero_copy_only=False)
            known = near >= 0
            count = np.where(known, head_counts[near] if len(head_counts) else 0, 0)
            n = np.diff(at)
            owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
            log_count = lg(count + 1.0)
            rare = ids >= len(words)
            inner = np.where(rare, log_count, 0) - share[ids]  # of the ending's class; the joined words add their part later
            network = net.score(ids[which], at) / math.log(10)
            score = network + np.bincount(owner, inner[which], len(n))
            base = np.bincount(owner, log_count[which], len(n)) - n * math.log10(least)
            seen = np.bincount(owner, known[which], len(n)).astype(np.int64)
            doc, tkey, out = batch.column("doc_id").cast(pa.int64()), batch.column("tkey"), batch.column("held_out")
            none = lambda m, kind: pa.nulls(m, kind)
            yield pa.RecordBatch.from_arrays([doc, tkey, out, pa.array(n), pa.array(seen), pa.array(base), pa.array(score), none(len(n), pa.string()), none(len(n), pa.int64())], names=NAMES)
            far = np.flatnonzero(~known[which])
            if len(far):
                pair, times = np.unique(owner[far].astype(np.int64) * len(found) + which[far], return_counts=True)
                o, w = pa.array(pair // len(found)), found.take(pa.array(pair % len(found))).cast(pa.string())
                m = len(pair)
                yield pa.RecordBatch.from_arrays([doc.take(o), tkey.take(o), none(m, pa.bool_()), none(m, pa.int64()), none(m, pa.int64()), none(m, pa.float64()), none(m, pa.float64()), w, pa.array(times)], names=NAMES)

    keyed = docs.select("doc_id", F.xxhash64("text").alias("tkey"), "held_out", "text")
    rows = scratch.table("rows", keyed.mapInArrow(run, "doc_id long, tkey long, held_out boolean, n_tokens long, n_known long, base_score double, score double, word string, times long"))
    of_docs = rows.where("word IS NULL").drop("word", "times")
    # words outside the head are rare by definition, so their join is even
    tail = rows.where("word IS NOT NULL").select("doc_id", "tkey", "word", "times").join(counted.select("word", "n"), "word")
    more = tail.groupBy(F.col("doc_id").alias("d"), F.col("tkey").alias("t")).agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("log_counts"), F.sum("times").alias("seen"))
    # equal rows each sent their words, so each takes its part of the sum
    equal = of_docs.groupBy(F.col("doc_id").alias("d"), F.col("tkey").alias("t")).agg(F.count(F.lit(1)).alias("copies"))
    more = more.join(equal.withColumnsRenamed({"d": "d2", "t": "t2"}), F.expr("d <=> d2 AND t = t2")).select("d", "t", (F.col("log_counts") / F.col("copies")).alias("log_counts"), F.expr("seen div copies").alias("seen"))
    both = of_docs.join(more, F.expr("doc_id <=> d AND tkey = t"), "left")
    add = F.coalesce("log_counts", F.lit(0.0))
    return both.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(int(n_train)).cast("long").alias("train_tokens"), (F.col("base_score") + add).alias("base_score"), (F.col("score") + add).alias("score"))


NAMES = ["doc_id", "tkey", "held_out", "n_tokens", "n_known", "base_score", "score", "word", "times"]
