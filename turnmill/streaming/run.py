"""Running a streaming query over what is there, and its result as a table in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..shipping import working_folder

#: What a batch of a stream becomes: from the batch, its number and a folder for state to the rows of the result.
Step = Callable[[DataFrame, int, str], DataFrame]


def source(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of a folder, or one file, as a stream. A stream reads folders, so one file is picked out of its own."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        reader, path = reader.option("pathGlobFilter", at.getName()), str(at.getParent())
    return reader.parquet(path)


def drain(stream: DataFrame, mode: str = "append", step: Step | None = None) -> DataFrame:
    """All of the stream's input, batch by batch; then the result. In complete mode each batch replaces the last one's table; a step
    makes the rows of that table itself."""
    spark, at = stream.sparkSession, working_folder(stream.sparkSession, "stream")
    kind = [stream.schema]

    def write(batch: DataFrame, number: int) -> None:
        rows = step(batch, number, f"{at}/kept") if step else batch
        kind[0] = rows.schema
        rows.write.mode("overwrite").parquet(f"{at}/{'table' if mode == 'complete' else f'table/batch={number}'}")

    finish(stream.writeStream.outputMode("append" if step else mode).option("checkpointLocation", f"{at}/state"), write)
    return spark.read.schema(kind[0]).parquet(f"{at}/table" if mode == "complete" else f"{at}/table/*")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def finish(writer: DataStreamWriter, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run the query over what is there now."""
    query = writer.trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))
    return query


def changes(stream: DataFrame, at: str | None = None, step: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """What each batch of a stream with keyed state gives out (made by `step`), with its number as `batch`, of all batches so far. State lies in
    RocksDB, whose checkpoints carry only what has changed. `at` is a folder in which a later call goes on; a repeated batch replaces its rows."""
    spark, at = stream.sparkSession, at or working_folder(stream.sparkSession, "stream")
    made = step or (lambda batch: batch)
    kind = [None]

    def write(batch: DataFrame, number: int) -> None:
        rows = made(batch)
        kind[0] = rows.schema
        rows.write.mode("overwrite").parquet(f"{at}/changes/batch={number}")

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:  # the query takes the setting as it starts
        finish(stream.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state"), write)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    rows = spark.read.parquet(f"{at}/changes") if kind[0] is None else spark.read.schema(kind[0].add("batch", T.IntegerType())).parquet(f"{at}/changes")
    return rows


def newest(stream: DataFrame, keys: tuple[str, ...], at: str | None = None) -> DataFrame:
    """The last row of each key among the changes of a stream."""
    rows = changes(stream, at)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")
