"""What the operators of this subpackage share: shipping code, working tables, words, Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import shared_folder
from ..shipping import ship as ship

#: Characters that separate words, as a Java and RE2 class, and the words themselves.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one numpy pass handles; a longer single text is handled alone.
CHUNK_BYTES = 4 << 20
#: The same for tokenizers, which look each distinct word up once for each pass.
WORD_BYTES = 8 << 20

_work: dict[str, str] = {}


def workspace(spark: SparkSession) -> str:
    """A folder of this application in the shared folder, removed as the driver ends."""
    name = spark.sparkContext.applicationId
    if name not in _work:
        _work[name] = path = f"{shared_folder(spark)}/turnmill-{name}"
        atexit.register(_quiet_remove, spark, path)
    return _work[name]


def _quiet_remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Working tables of one call. drop() deletes those that no later step reads, clear_scratch() all since a moment."""

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.at, self.paths = spark, f"{workspace(spark)}/{what}-{uuid.uuid4().hex[:12]}", {}
        Scratch.made.append(self)
        ship(spark)

    def table(self, name: str, df: DataFrame, compression: str = "zstd") -> DataFrame:
        path = self.paths[name] = f"{self.at}/{name}"
        df.write.mode("overwrite").option("compression", compression).parquet(path)
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.paths[name])

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.paths.pop(name))


def clear_scratch(since: int) -> None:
    """Delete the working tables of all calls after the first `since`, whose results have been written elsewhere."""
    for scratch in Scratch.made[since:]:
        remove(scratch.spark, scratch.at)
    del Scratch.made[since:]


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; further ones, whatever their names, are not read."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def give_back() -> None:
    """Memory that this worker has freed goes back to the system, as several workers share an executor."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another libc
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that no part holds over `most` bytes of text, unless it is one row. Runs in Python workers, whose freed
    memory goes back to the system after each batch."""
    pa.set_memory_pool(pa.system_memory_pool())
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
        give_back()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts, nulls as empty. They are copied, since kernels for strings may misread an array cut from a larger one."""
    return pc.fill_null(batch.column(column), "").take(pa.array(np.arange(batch.num_rows))).cast(pa.large_string())


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, one after another, and where each text's words begin (one more entry at the end)."""
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    offsets, values = parts.offsets.to_numpy().astype(np.int64), parts.flatten()
    full = pc.binary_length(values).to_numpy(zero_copy_only=False) > 0
    if not full.all():  # a blank text gives one empty word
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        values = values.filter(pa.array(full))
    return values, offsets


def lower_ascii(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(texts)


def flat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (lengths[0] numbers), starts[1], ... one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
