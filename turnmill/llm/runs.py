"""Maximal periodic runs of words by Main-Lorentz divide and conquer.

A text's words are interned. Every segment is halved at its midpoint; a run that crosses the midpoint shows as a place x of the
segment from which the text agrees, forward and backward, with the text from the midpoint for at least the distance of the two:
that distance is a period. How far it agrees is the Z-function of the midpoint and of its mirror image. All segments of a level,
of many texts, are worked at once: places whose next or last three words differ from the midpoint's are ruled out first, then
those without half the length that a run needs, and only the rest get their Z-values, by bisection over prefix hashes. The
runs are then compared word by word, so a hash decides nothing."""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import flat_ranges, pick, ship, slices, split_words, texts_of

MIN_LENGTH = 12
PRIME = np.uint64((1 << 31) - 1)
#: Words whose agreement with the midpoint's is looked at first; half of what any run of MIN_LENGTH needs is no less.
FIRST = 3


class Prefixes:
    """Polynomial hashes of all prefixes of a sequence of word numbers, modulo a prime."""

    def __init__(self, words: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        base, turn = (int(x) for x in rng.integers(1 << 20, int(PRIME), 2))
        power = np.ones(1, np.uint64)
        while len(power) <= len(words):
            power = np.concatenate([power, power * np.uint64(pow(base, len(power), int(PRIME))) % PRIME])
        self.power = power[: len(words) + 1]
        value = (words.astype(np.uint64) + np.uint64(turn)) % PRIME
        self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * self.power[:-1] % PRIME)]) % PRIME

    def same(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n words from `low` and from `high`, not before it, have one hash."""
        a, b = self.sum[low + n] + PRIME - self.sum[low], self.sum[high + n] + PRIME - self.sum[high]
        return a % PRIME * self.power[high - low] % PRIME == b % PRIME

    def longest(self, low: np.ndarray, high: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words, `most` at most, agree from (back: before) each pair of places."""
        n, open_ = np.zeros(len(low), np.int64), most.copy()
        while (n < open_).any():
            half = (n + open_ + 1) // 2
            good = self.same(low - half, high - half, half) if back else self.same(low, high, half)
            n, open_ = np.where(good, half, n), np.where(good, open_, half - 1)
        return n


def _crossing(words: np.ndarray, begin: np.ndarray, end: np.ndarray, min_length: int, seed: int) -> tuple[np.ndarray, ...]:
    """text, start, end, period of all that the midpoints of the texts' segments find, each interval with its least period."""
    hashes = Prefixes(words, seed)
    padded = np.concatenate([np.full(FIRST, -1), words, np.full(FIRST, -1)]).astype(np.uint64)
    triple = np.zeros(len(words) + FIRST, np.uint64)  # entry i: of the words from i - FIRST
    for j in range(FIRST):
        triple = triple * np.uint64(0x9E3779B97F4A7C15) + padded[j : j + len(triple)]
    text = np.flatnonzero(end - begin >= min_length)
    lo, hi = begin[text], end[text]
    cap = hi - lo  # longest period still looked for
    found: list[tuple[np.ndarray, ...]] = []
    while len(text):
        mid = (lo + hi) // 2
        x, seg = flat_ranges(lo, hi - lo), np.repeat(np.arange(len(lo)), hi - lo)
        after, before = triple[x + FIRST] == triple[mid + FIRST][seg], triple[x] == triple[mid][seg]
        at = np.flatnonzero(after | before)
        x, seg, after, before = x[at], seg[at], after[at], before[at]
        period = np.abs(x - mid[seg])
        use = np.flatnonzero((period > 0) & (period <= cap[seg]))
        x, seg, after, before, period = x[use], seg[use], after[use], before[use], period[use]
        low, high, first, last = np.minimum(x, mid[seg]), np.maximum(x, mid[seg]), begin[text[seg]], end[text[seg]]
        need = np.maximum(period, min_length - period)
        half = (need + 1) // 2
        after &= high + half <= last
        before &= low - half >= first
        after[after] = hashes.same(low[after], high[after], half[after])
        before[before] = hashes.same((low - half)[before], (high - half)[before], half[before])
        use = np.flatnonzero(after | before)
        seg, period, need, low, high, first, last = (v[use] for v in (seg, period, need, low, high, first, last))
        start, stop = low - hashes.longest(low, high, low - first, True), high + hashes.longest(low, high, last - high, False)
        use = np.flatnonzero(stop - start - period >= need)
        seg, period, start, stop = seg[use], period[use], start[use], stop[use]
        found.append((text[seg], start, stop, period))
        # in a segment inside a run, any run of no shorter period is that run
        left, right = cap.copy(), cap.copy()
        inside = start <= lo[seg]
        np.minimum.at(left, seg[inside], period[inside] - 1)
        inside = stop >= hi[seg]
        np.minimum.at(right, seg[inside], period[inside] - 1)
        text, cap, lo, hi = np.concatenate([text, text]), np.concatenate([left, right]), np.concatenate([lo, mid]), np.concatenate([mid, hi])
        use = np.flatnonzero((hi - lo >= min_length) & (cap > 0))
        text, cap, lo, hi = text[use], cap[use], lo[use], hi[use]
    which, start, stop, period = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4))
    order = np.lexsort((period, stop, start))
    which, start, stop, period = which[order], start[order], stop[order], period[order]
    new = np.ones(len(which), bool)
    new[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    return which[new], start[new], stop[new], period[new]


def maximal_runs(words: np.ndarray, at: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, start (in the text), length and period of every maximal run of at least two periods and `min_length` (6 or more) words.
    `words` are the word numbers of all texts, `at` where each begins. By text, start, length."""
    begin, end = at[:-1], at[1:]
    done: list[tuple[np.ndarray, ...]] = []
    todo = np.arange(len(begin))
    for seed in itertools.count():
        which, start, stop, period = _crossing(words, begin[todo], end[todo], min_length, seed)
        # hashes that met by chance can only make a run too long; such a text is done again with other ones
        true = np.array([np.array_equal(words[s : e - p], words[s + p : e]) for s, e, p in zip(start.tolist(), stop.tolist(), period.tolist())], bool)
        again = np.unique(which[~true])
        use = ~np.isin(which, again)
        which = which[use]
        done.append((todo[which], start[use] - begin[todo[which]], stop[use] - start[use], period[use]))
        if not len(again):
            break
        todo = todo[again]
    text, start, length, period = (np.concatenate([d[k] for d in done]) for k in range(4))
    order = np.lexsort((length, start, text))
    return text[order], start[order], length[order], period[order]


def collapse_runs(docs: DataFrame, min_length: int = MIN_LENGTH, take: Callable[[int, int], np.ndarray | None] | None = None, texts: bool = True) -> DataFrame:
    """For each row of (doc_id, text): doc_id, n_runs, start, length, period and exponent_milli (1000 * length / period, rounded down)
    of the longest run (of equal ones the first, then of least period; without a run nulls), runs_sha256 (of `start,length,period` and a line
    feed for each run by start, then period), collapsed_sha256, and with `texts` runs (structs) and collapsed: the words left, joined
    by one space, where of each run the words after its first period are gone.

    A run is a stretch of words with smallest period q (words q apart are equal), at least two periods and `min_length` words long, that no
    neighbouring word extends. `take(doc_id, n)`, if given, says which of a text's n words stand where (None: as they are). Null and
    blank texts have no words and no runs; for a null doc_id `take` isn't asked. Repeated rows and null doc_ids stay; an empty
    table gives no rows; columns besides doc_id and text are ignored."""
    ship(docs.sparkSession)
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    more = ", runs array<struct<start: long, length: long, period: long>>, collapsed string" if texts else ""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column("doc_id").cast(pa.int64())
            values, at = split_words(texts_of(batch))
            coded = values.cast(pa.large_binary()).dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            for k, doc in enumerate(ids.to_pylist() if take else []):
                n = int(at[k + 1] - at[k])
                if n and doc is not None and (own := take(doc, n)) is not None:
                    code[at[k] : at[k + 1]] = code[at[k] : at[k + 1]][own]
            text, start, length, period = maximal_runs(code, at, min_length)
            edge = np.zeros(len(code) + 1, np.int64)
            np.add.at(edge, at[text] + start + period, 1)
            np.add.at(edge, at[text] + start + length, -1)
            keep = np.cumsum(edge)[:-1] == 0
            left = np.concatenate([[0], np.cumsum(keep)])[at]
            rest = coded.dictionary.take(pa.array(code[keep])) if len(code) else values.cast(pa.large_binary())
            whole = b" ".join(rest.to_pylist())
            begin = np.concatenate([[0], np.cumsum(pc.binary_length(rest).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])[left].tolist()
            kept = [whole[a : max(a, b - 1)] for a, b in zip(begin, begin[1:])]
            bound = np.searchsorted(text, np.arange(batch.num_rows + 1)).tolist()
            rows = list(zip(start.tolist(), length.tolist(), period.tolist()))
            runs = [sorted(rows[a:b], key=lambda r: (r[0], r[2])) for a, b in zip(bound, bound[1:])]
            best = [min(r, key=lambda x: (-x[1], x[0], x[2])) if r else (None, None, None) for r in runs]
            columns = [ids, pa.array([len(r) for r in runs], pa.int64()), *(pa.array([b[k] for b in best], pa.int64()) for k in range(3)), pa.array([b[1] * 1000 // b[2] if b[1] else None for b in best], pa.int64()), pa.array([hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in r).encode()).hexdigest() for r in runs]), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
            if texts:
                columns += [pa.array([[dict(zip(("start", "length", "period"), x)) for x in r] for r in runs], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", *(["runs", "collapsed"] if texts else [])])

    return pick(docs, "doc_id", "text").mapInArrow(work, schema + more)


def planted(doc_id: int, n: int) -> np.ndarray | None:
    """In one of ten documents, chosen by the CRC-32 of its id, all words from one on repeat with one period."""
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)
