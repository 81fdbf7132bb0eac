"""Order-preserving packing of documents into training windows.

A dynamic programme over the cut positions (document ends, sentence ends, clause ends, and forced cuts inside long clauses) minimises padding plus a penalty for each cut that truncates a document or a sentence. The transition looks
back one window, so a monotone queue of candidate predecessors makes it linear in the number of cut positions."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import WORD_BYTES, pick, ship, slices, texts_of
from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"


@dataclass(frozen=True)
class Costs:
    """In padding tokens: what a cut costs besides the padding before it."""

    window: int = 4096
    document_end: float = 0.0
    sentence_end: float = 2.0
    #: After a comma, colon or semicolon.
    clause_end: float = 5.0
    inside_clause: float = 24.0
    #: A stretch without any such end gets a forced cut position every window // forced tokens.
    forced: int = 32


def best_cuts(position: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """Indices into `position` (ascending, from 0, steps <= window) of the window borders of least total cost, where
    a window from j to i costs window - (position[i] - position[j]) + penalty[i]; the last one is open and costs no padding."""
    pos, pen = position.tolist(), penalty.tolist()
    n = len(pos)
    back = [0] * n
    value = [0.0] * n  # cost[j] + position[j]
    queue: deque[int] = deque([0])
    for i in range(1, n):
        p = pos[i]
        while p - pos[queue[0]] > window:
            queue.popleft()
        j = queue[0]
        back[i] = j
        v = value[i] = value[j] + window + pen[i]  # the position cancels out
        while queue and value[queue[-1]] > v:
            queue.pop()
        queue.append(i)
    within = range(int(np.searchsorted(position, pos[-1] - window)), n - 1)
    back[-1] = min(within, key=lambda j: value[j] - pos[j])
    cuts, i = [], n - 1
    while i:
        cuts.append(i)
        i = back[i]
    return [0, *reversed(cuts)]


def cut_positions(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, costs: Costs) -> tuple[np.ndarray, np.ndarray]:
    """All allowed borders with their penalties; 0 and the end of the ids are among them. ends: by id, 2 for one that
    ends a sentence and 1 for one that ends a clause."""
    total = len(ids)
    kind = ends[ids]
    here = np.zeros(total + 1, bool)
    here[1:] = kind > 0
    here[doc_ends] = here[0] = here[total] = True
    free = np.flatnonzero(here)
    gap, step = np.diff(free), max(1, costs.window // costs.forced)
    for k in np.flatnonzero(gap > step).tolist():
        here[free[k] + step : free[k + 1] : step] = True
    position = np.flatnonzero(here)
    penalty = np.array([costs.inside_clause, costs.clause_end, costs.sentence_end])[kind[position - 1]] if total else np.zeros(1)
    ends_doc = np.zeros(total + 1, bool)
    ends_doc[doc_ends] = True
    penalty[ends_doc[position]] = costs.document_end
    penalty[[0, -1]] = 0
    return position, penalty


class Packer:
    """Packs a stream of documents. Windows are given out once what follows can hardly change them; the last two of
    each chunk wait for the next chunk."""

    def __init__(self, ends: np.ndarray, costs: Costs, first_sequence: int, dtype=np.uint16):
        self.ends, self.costs, self.next = ends, costs, first_sequence
        self.ids = np.zeros(0, dtype)
        self.docs: list[tuple] = []  # doc_id, position of its first id in self.ids (may be negative), its ids in all

    def add(self, doc_ids: list, ids: np.ndarray, at: np.ndarray) -> list[tuple]:
        base = len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        size = np.diff(at)
        self.docs += zip(doc_ids, (at[:-1] + base).tolist(), size.tolist(), strict=True)
        return self._pack(last=False)

    def finish(self) -> list[tuple]:
        return self._pack(last=True)

    def _pack(self, last: bool) -> list[tuple]:
        total, window = len(self.ids), self.costs.window
        if not total or not last and total < 4 * window:
            return []
        doc_ends = np.array([p + n for _, p, n in self.docs if p + n > 0], np.int64)
        position, penalty = cut_positions(self.ids, doc_ends, self.ends, self.costs)
        cuts = position[best_cuts(position, penalty, window)].tolist()
        if last:  # the rest goes into sequences of a power of two each, which need no padding
            begin, rest = cuts[-2], cuts[-1] - cuts[-2]
            cuts.pop()
            for bit in range(rest.bit_length() - 1, -1, -1):
                if rest >> bit & 1:
                    begin += 1 << bit
                    cuts.append(begin)
        else:
            cuts = cuts[: max(1, len(cuts) - 2)]
        out = []
        k = 0
        for a, b in zip(cuts, cuts[1:]):
            offset = 0
            while offset < b - a:
                doc, p, n = self.docs[k]
                lo, hi = max(a, p), min(b, p + n)
                if hi > lo:
                    out.append((doc, lo - p, hi - lo, zlib.crc32(self.ids[lo:hi].astype("<u4").tobytes()), n, self.next, offset))
                    offset += hi - lo
                if p + n <= b:
                    k += 1
            self.next += 1
        done = cuts[-1]
        self.docs = [(d, p - done, n) for d, p, n in self.docs[k:]]
        self.ids = self.ids[done:].copy()
        return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, costs: Costs = Costs()) -> DataFrame:
    """Pieces of all documents of (doc_id, text), packed within each input partition in its order; nothing is shuffled.

    One row for each piece: doc_id, start (ids of its document before it), length, ids_crc32 (of its ids as little-endian
    32-bit integers), doc_tokens (with the end id), sequence_id (partition << 33 | number there), offset. Sequences hold up
    to costs.window ids; what is left at a partition's end goes into sequences of a power of two. A null or empty text is
    its end id alone; a null doc_id stays null; repeated rows are packed as often as they occur; an empty table gives no
    rows; columns besides doc_id and text are ignored. A long text is cut into as many windows as it needs."""
    ship(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        ends = np.zeros(max(max(code.vocab.values()), end_id) + 1, np.int8)
        ends[code.marks(",;:")] = 1
        ends[code.marks(".!?…")] = 2
        packer = Packer(ends, costs, TaskContext.get().partitionId() << 33, code.dtype)
        for batch in slices(batches, most=WORD_BYTES):
            ids, at = code.encode(texts_of(batch), end_id)
            yield _rows(packer.add(batch.column("doc_id").to_pylist(), ids, at))
        yield _rows(packer.finish())

    return pick(docs, "doc_id", "text").mapInArrow(pack, SCHEMA)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 7)], names=list(names))
