"""Distinct counts that merge: visitors as numbers, and a bitmap of these for each bucket of time.

A visitor's number never changes, so bitmaps of two times can be put together and counted without going back to the requests: hours,
days and any span of days come from the bitmaps of buckets. A bitmap is cut into pieces of 32,768 numbers, which are rows of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ingest import with_ids


def numbered(requests: DataFrame, known: DataFrame | None = None, key: str = "visitor") -> DataFrame:
    """(key, number) of all visitors: those known keep their numbers, new ones get the next, in the order of their names."""
    new = requests.select(key).where(F.col(key).isNotNull()).distinct()
    if known is None:
        return with_ids(new, 0, key).select(key, F.col("id").alias("number"))
    new = new.join(known.select(key), key, "left_anti")
    start = known.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    return known.select(key, "number").unionByName(with_ids(new, start, key).select(key, F.col("id").alias("number")))


def bucket_bitmaps(requests: DataFrame, numbers: DataFrame, bucket: Column, key: str = "visitor") -> DataFrame:
    """(bucket_epoch, piece, bits): the visitors of each bucket."""
    seen = requests.select(bucket.alias("bucket_epoch"), key).join(numbers, key)
    return seen.groupBy("bucket_epoch", F.expr("bitmap_bucket_number(number)").alias("piece")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(number))").alias("bits"))


def merged_bitmaps(old: DataFrame, new: DataFrame) -> DataFrame:
    """Bitmaps of two loads as one; a load that comes twice changes nothing."""
    return old.unionByName(new).groupBy("bucket_epoch", "piece").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))


def rolled_up(bitmaps: DataFrame, span: Column, name: str) -> DataFrame:
    """The bitmaps of longer spans of time, `span` of a bucket's time."""
    return bitmaps.groupBy(span.alias(name), "piece").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))


def distinct_visitors(bitmaps: DataFrame, *by: str) -> DataFrame:
    """Visitors of each span."""
    return bitmaps.groupBy(*by).agg(F.sum(F.expr("bitmap_count(bits)")).alias("visitors"))


def trailing(days: DataFrame, n: int, day: str = "day") -> DataFrame:
    """The bitmaps of each day together with the n - 1 days before it, from bitmaps by day (a number). A day's pieces go to the n days
    that they count for, so the work is n times the days' bitmaps and never the requests'."""
    last = days.agg(F.max(day).alias("last"))
    spread = days.crossJoin(F.broadcast(last)).select(F.explode(F.sequence(F.col(day), F.least(F.col(day) + (n - 1), F.col("last")))).alias(day), "piece", "bits")  # one row
    return spread.groupBy(day, "piece").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
