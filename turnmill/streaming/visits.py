"""Visits and the request guard as Structured Streaming queries. Sources have ip, epoch, path, method, status, blocked, visitor, id."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.guard import Limits
from ..operators.visits import BUCKET, STATE, bucket
from ..operators.visits import guard_step as guarded
from ..shipping import Working
from . import run
from .run import Step, drain


def timed(requests: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return requests.withColumn("ts", F.timestamp_seconds("epoch")).withWatermark("ts", delay)


def ip_activity(requests: DataFrame, seconds: int = BUCKET, delay: str = "10 minutes") -> DataFrame:
    """Tumbling windows by ip. Requests later than the delay are dropped with their window's state."""
    last = lambda c: F.max_by(c, F.struct("epoch", "id")).alias(f"last_{c}")
    out = timed(requests, delay).groupBy("ip", F.window("ts", f"{seconds} seconds")).agg(F.min("epoch").alias("first_seen_epoch"), F.max("epoch").alias("last_seen_epoch"), F.count(F.lit(1)).alias("request_count"), F.sum("blocked").alias("blocked_count"), last("path"), last("method"), last("status"))
    return out.withColumn("bucket_epoch", F.unix_seconds("window.start")).drop("window")


def activity_changes(requests: DataFrame, seconds: int = BUCKET, keep: str = "10 days") -> DataFrame:
    """The sums by ip and bucket as they change: a row in each batch for each that has new requests. A late request counts like any other until
    the watermark has left its bucket behind, and the bucket's state goes then. For run.newest(keys=("ip", "bucket_epoch"))."""
    names = ("ip", "bucket_epoch", "first_seen_epoch", "last_seen_epoch", "request_count", "blocked_count", "last_path", "last_method", "last_status")
    return ip_activity(requests, seconds, keep).select(*names)


def first_visits(requests: DataFrame, seconds: int = BUCKET, keep: str = "10 days") -> DataFrame:
    """(bucket_epoch, visitor) once for each visitor of a bucket, over batches and however late within `keep`; a state for each, which goes then."""
    seen = timed(requests, keep).select("ts", bucket(F.col("epoch"), seconds).alias("bucket_epoch"), "visitor")
    return seen.dropDuplicatesWithinWatermark(["bucket_epoch", "visitor"])


def online_counts(requests: DataFrame, seconds: int = BUCKET, keep: str = "10 days", at: str | None = None) -> DataFrame:
    """Visitors online in each bucket: every batch adds how many are new in it."""
    added = run.changes(first_visits(requests, seconds, keep), at, lambda batch: batch.groupBy("bucket_epoch").agg(F.count("visitor").alias("n")))
    return added.groupBy("bucket_epoch").agg(F.sum("n").alias("online"))


class Peak(StatefulProcessor):
    """The newest number of a bucket's visitors, and the greatest; a timer clears it when the watermark has passed `keep` seconds after."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.known = handle, handle.getValueState("known", "recorded long, online long, peak long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.known.get() if self.known.exists() else None
        if known is None:
            self.handle.registerTimer(key[0] * 1000)
        recorded, online, peak = known or (-1, 0, 0)
        for f in rows:
            for r in f.itertuples():
                if r.recorded >= recorded:
                    recorded, online = int(r.recorded), int(r.online)
                peak = max(peak, int(r.online))
        self.known.update((recorded, online, peak))
        yield pd.DataFrame([(key[0], online, peak, recorded)], columns=["bucket_epoch", "online", "peak", "recorded"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.known.clear()
        return iter(())

    def close(self) -> None:
        pass


def peak_changes(snapshots: DataFrame, keep: str = "10 days") -> DataFrame:
    """Snapshots (bucket_epoch, online, recorded) merged bucket by bucket: the newest number and the greatest. For run.newest(keys=("bucket_epoch",))."""
    keyed = snapshots.select(F.timestamp_seconds("bucket_epoch").alias("ts"), "bucket_epoch", "online", "recorded").withWatermark("ts", keep)
    return keyed.groupBy("bucket_epoch").transformWithStateInPandas(Peak(), "bucket_epoch long, online long, peak long, recorded long", "Update", "EventTime")


def guard_step(limits: Limits = Limits()) -> Step:
    """The guard for run.drain() or a foreachBatch of one's own. Its state has a row for each identity, so a visitor who changes
    address, in a batch or between batches, is met again. Each batch writes the rows of the identities that it touches, and reads of earlier ones
    the newest of these; rows that say nothing any more are passed over by the bounds of their files. A repeated batch starts from the
    same rows."""

    def step(batch: DataFrame, number: int, at: str) -> DataFrame:
        spark = batch.sparkSession
        old, first = None, batch.agg(F.min("epoch")).first()[0]
        if number and first is not None:
            names = T._parse_datatype_string(STATE).names
            rows = spark.read.schema(f"{STATE}, batch int").option("ignoreMissingFiles", True).parquet(f"{at}/guard").where((F.col("batch") < number) & (F.col("alive") > float(first)))
            old = rows.groupBy("identity").agg(F.max_by(F.struct(*names[1:]), "batch").alias("x")).select("identity", "x.*")
        out, state = guarded(batch, old, limits, Working(spark, "guard"))
        state.write.mode("overwrite").parquet(f"{at}/guard/batch={number}")
        return out

    return step


def guard_requests(requests: DataFrame, policies: dict | None = None) -> DataFrame:
    """Decisions on all that the stream has now."""
    return drain(requests, step=guard_step(Limits(policies=dict(policies)) if policies else Limits()))
