"""Token files compressed by range asymmetric numeral systems with static tables.

A section is a self-contained file: header, one frequency table shared by its blocks, document directory, block
directory with checksums, checkpoints, and the blocks' words. In a block `lanes` states are interleaved; a checkpoint
holds all states and the place in the words, so that a reader decodes all stretches between checkpoints at once, each
numpy operation working on every lane of every stretch. Layout, little-endian, in this order:

header  magic 8s, version u4, scale bits u4, lanes u4, steps per stretch u4, stretches per block u4, symbols u4, blocks u4,
        documents u8, ids u8, end id u4, crc32 of all that follows u4
table   symbols (u4 each), frequencies (u4 each, sum 2**scale)
docs    present u1 each, doc_id i8 each, ids u4 each
blocks  ids u4, words u4, crc32 of the block's ids as u4 integers: u4 (3 for each block)
points  for each block and stretch: word offset u4, then a state u8 for each lane
words   u4 each, block after block"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BYTES, Scratch, pick, slices, texts_of
from .tokens import encoder

MAGIC, VERSION = b"TMRANS\0\0", 1
HEAD = struct.Struct("<8sIIIIIIIQQII")
SCALE, LANES, STEPS, STRETCHES = 18, 32, 512, 4
SECTION_IDS = 1 << 22
LOW = np.uint64(1 << 31)


class Corrupt(ValueError):
    """A checksum or the layout of a section is wrong."""


def quantise(counts: np.ndarray, scale: int) -> np.ndarray:
    """Frequencies of at least 1 each that sum to 2**scale, close to the counts' shares."""
    total = 1 << scale
    if len(counts) > total:
        raise ValueError("more symbols than slots")
    share = counts / counts.sum() * (total - len(counts))
    freq = 1 + np.floor(share).astype(np.int64)
    left = total - int(freq.sum())
    freq[np.argsort(np.floor(share) - share, kind="stable")[:left]] += 1
    return freq


def encode_section(ids: np.ndarray, doc_ids: list, lengths: np.ndarray, end_id: int, scale: int = SCALE, lanes: int = LANES, steps: int = STEPS, stretches: int = STRETCHES) -> bytes:
    ids = ids.astype(np.uint32)
    seen = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    symbols = np.flatnonzero(seen)
    counts, place = seen[symbols], np.cumsum(seen > 0) - 1
    dense = place.astype(np.int32)[ids]
    while len(symbols) > 1 << (scale - 1):
        scale += 1
    freq = quantise(counts, scale) if len(symbols) else np.zeros(0, np.int64)
    start = np.cumsum(freq) - freq
    per_block = lanes * steps * stretches
    blocks = -(-len(ids) // per_block)
    depth = steps * stretches
    filled = np.full(blocks * per_block, int(np.argmax(counts)) if len(counts) else 0, np.int32)
    filled[: len(ids)] = dense
    grid = np.ascontiguousarray(filled.reshape(blocks, depth, lanes).transpose(1, 0, 2))
    f_all, c_all = freq.astype(np.uint64), start.astype(np.uint64)
    state = np.full((blocks, lanes), LOW, np.uint64)
    words = np.zeros((depth, blocks, lanes), np.uint32)
    sent = np.zeros((depth, blocks, lanes), bool)
    points = np.zeros((stretches, blocks, lanes), np.uint64)
    shift, up, word = np.uint64(scale), np.uint64(63 - scale), np.uint64(32)
    for t in range(depth - 1, -1, -1):
        f, c = f_all[grid[t]], c_all[grid[t]]
        out = state >= f << up
        sent[t] = out
        words[t] = state.astype(np.uint32)
        state = np.where(out, state >> word, state)
        q = state // f
        state = (q << shift) + (state - q * f) + c
        if t % steps == 0:
            points[t // steps] = state
    n_words = sent.sum(axis=2)  # by step and block
    before = np.cumsum(n_words, axis=0) - n_words
    flow = words.transpose(1, 0, 2)[sent.transpose(1, 0, 2)]
    crcs = [zlib.crc32(ids[b * per_block : (b + 1) * per_block].astype("<u4").tobytes()) for b in range(blocks)]
    sizes = np.minimum(per_block, len(ids) - np.arange(blocks) * per_block)
    body = b"".join(
        [
            symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes(),
            np.array([d is not None for d in doc_ids], "u1").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.asarray(lengths).astype("<u4").tobytes(),
            np.stack([sizes, n_words.sum(axis=0), np.array(crcs, np.int64)], axis=1).astype("<u4").tobytes() if blocks else b"",
            *[before[s * steps, b].astype("<u4").tobytes() + points[s, b].astype("<u8").tobytes() for b in range(blocks) for s in range(stretches)],
            flow.astype("<u4").tobytes(),
        ]
    )
    return HEAD.pack(MAGIC, VERSION, scale, lanes, steps, stretches, len(symbols), blocks, len(doc_ids), len(ids), end_id, zlib.crc32(body)) + body


def decode_section(raw: bytes) -> tuple[np.ndarray, list, np.ndarray]:
    """ids (u4), doc_ids and their numbers of ids."""
    magic, version, scale, lanes, steps, stretches, n_symbols, blocks, n_docs, n_ids, _, crc = HEAD.unpack_from(raw)
    if magic != MAGIC or version != VERSION:
        raise Corrupt("not a section of this version")
    if zlib.crc32(memoryview(raw)[HEAD.size :]) != crc:
        raise Corrupt("checksum of the section")
    at = HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        a = np.frombuffer(raw, kind, n, at)
        at += a.nbytes
        return a

    symbols, freq = take("<u4", n_symbols), take("<u4", n_symbols).astype(np.uint64)
    present, names, lengths = take("u1", n_docs), take("<i8", n_docs), take("<u4", n_docs).astype(np.int64)
    doc_ids = [d if p else None for p, d in zip(present.tolist(), names.tolist(), strict=True)]
    if not blocks:
        return np.zeros(0, np.uint32), doc_ids, lengths
    directory = take("<u4", 3 * blocks).reshape(blocks, 3).astype(np.int64)
    kind = np.dtype([("at", "<u4"), ("state", "<u8", (lanes,))])
    points = np.frombuffer(raw, kind, blocks * stretches, at).reshape(blocks, stretches)
    at += points.nbytes
    flow = np.concatenate([take("<u4", int(directory[:, 1].sum())), np.zeros(lanes + 1, np.uint32)]).astype(np.uint64)
    first = np.cumsum(directory[:, 1]) - directory[:, 1]
    place = (first[:, None] + points["at"]).reshape(-1, 1).astype(np.int64)
    state = points["state"].reshape(-1, lanes).astype(np.uint64)
    begin = np.cumsum(freq) - freq
    slot_symbol = np.repeat(np.arange(n_symbols, dtype=np.uint32), freq.astype(np.int64))
    mask, shift, word = np.uint64((1 << scale) - 1), np.uint64(scale), np.uint64(32)
    out = np.empty((steps, blocks * stretches, lanes), np.uint32)
    for t in range(steps):
        slot = state & mask
        s = slot_symbol[slot]
        out[t] = s
        state = freq[s] * (state >> shift) + slot - begin[s]
        need = state < LOW
        rank = np.cumsum(need, axis=1)
        got = flow[np.minimum(place + rank - 1, len(flow) - 1)]
        state = np.where(need, state << word | got, state)
        place = place + rank[:, -1:]
    dense = out.reshape(steps, blocks, stretches, lanes).transpose(1, 2, 0, 3).reshape(-1)[:n_ids]
    ids = symbols[dense]
    size = lanes * steps * stretches
    for b in range(blocks):
        if zlib.crc32(ids[b * size : (b + 1) * size].astype("<u4").tobytes()) != directory[b, 2]:
            raise Corrupt(f"checksum of block {b}")
    return ids, doc_ids, lengths


SECTIONS = "file_no int, section_no int, n_docs long, n_tokens long, section binary"


def write_sections(docs: DataFrame, tokenizer: str, end_id: int, scratch: Scratch, section_ids: int = SECTION_IDS) -> DataFrame:
    """Sections of all documents of (doc_id, text) in ascending doc_id order (nulls first, equal doc_ids by the text's
    hash), one file for each partition of a range partitioning."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, file, section = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        for batch in slices(batches, most=WORD_BYTES):
            ids, at = code.encode(texts_of(batch), end_id)
            held.append((batch.column("doc_id").to_pylist(), ids, np.diff(at)))
            if sum(len(x[1]) for x in held) >= section_ids:
                yield _section(file, section, held, end_id)
                held, section = [], section + 1
        if held:
            yield _section(file, section, held, end_id)

    # the hash, taken of rows without a doc_id alone, keeps these from meeting in one partition
    h = F.xxhash64("text")
    ordered = pick(docs, "doc_id", "text").repartitionByRange("doc_id", F.when(F.col("doc_id").isNull(), h)).sortWithinPartitions("doc_id", h)
    return scratch.table("sections", ordered.mapInArrow(write, SECTIONS), "uncompressed")


def _section(file: int, section: int, held: list[tuple], end_id: int) -> pa.RecordBatch:
    doc_ids = [d for x in held for d in x[0]]
    ids, lengths = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
    raw = encode_section(ids, doc_ids, lengths, end_id)
    values = ((file, pa.int32()), (section, pa.int32()), (len(doc_ids), pa.int64()), (len(ids), pa.int64()), (raw, pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in values], names=["file_no", "section_no", "n_docs", "n_tokens", "section"])


def read_sections(sections: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it in all files), n_tokens, ids_crc32, decoded from the sections."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, section, raw in zip(*(batch.column(n) for n in ("file_no", "section_no", "section")), strict=True):
                ids, doc_ids, lengths = decode_section(raw.as_py())
                at = np.concatenate([[0], np.cumsum(lengths)])
                wide = ids.astype("<u4")
                crcs = [zlib.crc32(wide[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                n = len(doc_ids)
                values = (pa.array([file.as_py()] * n, pa.int32()), pa.array([section.as_py()] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(at[:-1]), pa.array(lengths), pa.array(crcs, pa.int64()))
                yield pa.RecordBatch.from_arrays(list(values), names=["file_no", "section_no", "doc_id", "start", "n_tokens", "ids_crc32"])

    rows = sections.select("file_no", "section_no", "section").mapInArrow(read, "file_no int, section_no int, doc_id long, start long, n_tokens long, ids_crc32 long")
    # sections are few (one for some four million ids): files are summed first, then sections within each file
    sizes = sections.select("file_no", "section_no", "n_tokens")
    files = sizes.groupBy("file_no").agg(F.sum("n_tokens").alias("n")).select("file_no", (F.sum("n").over(Window.orderBy("file_no")) - F.col("n")).alias("file_start"))
    begins = sizes.join(files, "file_no").select("file_no", "section_no", (F.col("file_start") + F.sum("n_tokens").over(Window.partitionBy("file_no").orderBy("section_no")) - F.col("n_tokens")).alias("base"))
    return rows.join(begins, ["file_no", "section_no"]).select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read_back(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes all documents of (doc_id, text) as sections in the shared folder and returns what reading them back gives.

    A null or empty text is its end id alone. Null doc_ids come first; rows with one doc_id all stay, ordered by the hash
    of their text. An empty table gives no rows. Columns besides doc_id and text are ignored. A damaged section raises
    Corrupt."""
    return read_sections(write_sections(docs, tokenizer, end_id, Scratch(docs.sparkSession, "rans")))
