"""Turns stored by conversation: in buckets of the conversation's key, sorted by turn in each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import working_folder


def by_conversation(turns: DataFrame, name: str | None = None, buckets: int = 64) -> DataFrame:
    """Store the turns as a table and read it. What works conversation by conversation on it (adjacent pairs, windows of turns, counts of
    conversations) needs no shuffle, as a conversation lies in one bucket. A table with a name lies where the catalogue keeps its own;
    without one it is a working table, which goes when the driver ends."""
    spark = turns.sparkSession
    kept = name or f"turns_{uuid.uuid4().hex[:12]}"
    writer = turns.repartition(buckets, "conversation_key").write.mode("overwrite").bucketBy(buckets, "conversation_key").sortBy("conversation_key", "turn_index", "id")
    (writer if name else writer.option("path", working_folder(spark, "turns"))).saveAsTable(kept)
    return spark.table(kept)


def conversation_counts(turns: DataFrame) -> DataFrame:
    """Turns and distinct speakers of each conversation."""
    return turns.groupBy("conversation_key").agg(F.count("*").alias("n_turns"), F.count_distinct("speaker_label").alias("n_speakers"))
