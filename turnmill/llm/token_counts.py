"""Token counts of documents read off flat token files that have no index: only end-of-document ids tell where one ends.

write_flat() makes such files (one for each partition) as rows of fixed-size blocks. count_tokens() searches each block
for separators with numpy and stitches documents that cross blocks by a prefix scan over the blocks of a file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BYTES, Scratch, pick, slices, texts_of
from .tokens import encoder

FLAT = "file_no int, block_no int, ids binary, first_doc long, doc_ids array<long>"
BLOCK_IDS = 1 << 20


def write_flat(docs: DataFrame, tokenizer: str, end_id: int, scratch: Scratch, block_ids: int = BLOCK_IDS, dtype: str = "<u2") -> DataFrame:
    """The flat files of (doc_id, text): rows with ids are blocks (file_no, block_no, ids), all but a file's last of
    block_ids ids of the given dtype; rows with doc_ids list the documents of a file in its order, from number first_doc on."""

    if end_id > np.iinfo(dtype).max:
        raise ValueError(f"the end id {end_id} does not fit in {dtype}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, file, block, seen = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        rest: list[np.ndarray] = []
        held = 0
        for batch in slices(batches, most=WORD_BYTES):
            ids, _ = code.encode(texts_of(batch), end_id)
            if len(ids) and int(ids.max()) > np.iinfo(dtype).max:
                raise ValueError(f"an id of over {np.iinfo(dtype).max} does not fit in {dtype}")
            if np.count_nonzero(ids == end_id) != batch.num_rows:
                raise ValueError(f"the end id {end_id} is also an id of a text")
            yield _flat([(file, None, None, seen, batch.column("doc_id").to_pylist())])
            seen += batch.num_rows
            rest.append(ids)
            held += len(ids)
            if held >= block_ids:
                whole = np.concatenate(rest)
                for _ in range(held // block_ids):
                    yield _flat([(file, block, whole[:block_ids].astype(dtype).tobytes(), None, None)])
                    whole, block = whole[block_ids:], block + 1
                rest, held = [whole], len(whole)
        if held:
            yield _flat([(file, block, np.concatenate(rest).astype(dtype).tobytes(), None, None)])

    return scratch.table("flat", pick(docs, "doc_id", "text").mapInArrow(write, FLAT))


def _flat(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds, strict=True)], names=["file_no", "block_no", "ids", "first_doc", "doc_ids"])


def scan_blocks(flat: DataFrame, end_id: int, block_ids: int = BLOCK_IDS, dtype: str = "<u2") -> DataFrame:
    """A row for each document of each file: file_no, doc_no (from 0), start, n_tokens (with the end id), all from the
    blocks alone. Ids after a file's last separator make a last, unended document."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, raw in zip(*(batch.column(n).to_pylist() for n in ("file_no", "block_no", "ids")), strict=True):
                ids = np.frombuffer(raw, dtype)
                ends = np.flatnonzero(ids == end_id) + 1 + block * block_ids
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((file, pa.int32()), (block, pa.int32()), (block * block_ids + len(ids), pa.int64()), (ends, pa.list_(pa.int64())))], names=["file_no", "block_no", "until", "ends"])

    blocks = flat.where("ids IS NOT NULL").select("file_no", "block_no", "ids").mapInArrow(search, "file_no int, block_no int, until long, ends array<long>")
    before = Window.partitionBy("file_no").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("file_no").orderBy("block_no").rowsBetween(1, Window.unboundedFollowing)
    stitched = blocks.select(
        "file_no",
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.max(F.array_max("ends")).over(before), F.lit(0)).alias("open_since"),
        # a file that stops without a separator still ends its last document
        F.when(F.count(F.lit(1)).over(after).__eq__(0) & (F.coalesce(F.array_max("ends"), F.lit(-1)) < F.col("until")), F.array_append("ends", F.col("until"))).otherwise(F.col("ends")).alias("ends"),
    )
    return stitched.select("file_no", "docs_before", "open_since", "ends", F.posexplode("ends").alias("k", "end")).select(
        "file_no",
        (F.col("docs_before") + F.col("k")).alias("doc_no"),
        (s := F.when(F.col("k") > 0, F.col("ends")[F.col("k") - 1]).otherwise(F.col("open_since"))).alias("start"),
        (F.col("end") - s).alias("n_tokens"),
    )


def count_tokens(docs: DataFrame, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """doc_id, file_no, start, n_tokens (with the end id) for each row of (doc_id, text), by writing flat token files and
    scanning them. A null or empty text has one token, its end; null doc_ids and repeated rows are kept as they are; an
    empty table gives no rows; other columns are ignored. An end_id that a text has too, or an id that the files' 16 bits do not
    hold, is a ValueError."""
    flat = write_flat(docs, tokenizer, end_id, Scratch(docs.sparkSession, "flat"), block_ids)
    names = flat.where("doc_ids IS NOT NULL").select("file_no", "first_doc", F.posexplode("doc_ids").alias("k", "doc_id")).select("file_no", (F.col("first_doc") + F.col("k")).alias("doc_no"), "doc_id")
    return scan_blocks(flat, end_id, block_ids).join(names, ["file_no", "doc_no"]).select("doc_id", "file_no", "start", "n_tokens")
