"""Tables stored by conversation, merged by partition, and visitors as bitmaps."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from turnmill.operators import bitmaps as B
from turnmill.operators import pairs as P
from turnmill.operators.layout import by_conversation, conversation_counts
from turnmill.operators.merging import copy_with_retries, merge_into

TURNS = "id long, entry_id long, turn_index int, speaker_label string, turn_text string, source string, category string, dataset_name string, conversation_key string"


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(c * 1000 + t, c, t, "甲乙"[t % 2], f"话{t}", "", "", "", f"entry:{c}") for c in range(20) for t in range(1, 2 + c) if (c + t) % 7]
    return spark.createDataFrame([*rows, (5, 3, 2, "丙", "again", "", "", "", "entry:3")], TURNS).repartition(5)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_turns_need_no_shuffle(turns):
    kept = by_conversation(turns, buckets=4)
    for df in (P.adjacent_pairs(kept), P.pairs_with_windows(kept, "context2"), P.pairs_with_windows(kept, "full"), conversation_counts(kept)):
        assert "Exchange" not in _plan(df)
    assert sorted(map(str, P.adjacent_pairs(kept).collect())) == sorted(map(str, P.adjacent_pairs(turns).collect()))


@pytest.mark.parametrize("window", ["pair", "context2", "context5", "full"])
def test_windows_in_one_pass_equal_those_by_joins(turns, window):
    one = P.pairs_with_windows(turns, window)
    want = P.window_turns(P.adjacent_pairs(turns), turns, window)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100


def test_merges_leave_other_folders_alone(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = [(k, f"title {k}", 2000 + k % 5) for k in range(100)] + [(100, "no year", None)]
    schema = "id long, title string, year int"
    assert merge_into(path, spark.createDataFrame(rows, schema), ("id",), "year", 0)
    files = lambda: {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{tmp_path}/t/year=*/*.parquet")}
    before = files()
    changes = spark.createDataFrame([(3, "new", 2003), (203, "added", 2003), (100, "still none", None)], schema)
    assert merge_into(path, changes, ("id",), "year", 1)
    after = files()
    same = {p for p in before if "year=2003" not in p and "HIVE" not in p}
    assert len(same) >= 4 and all(after[p] == before[p] for p in same)
    assert not any(p in after for p in before if "year=2003" in p)
    # a repeated batch writes nothing
    assert not merge_into(path, changes, ("id",), "year", 1) and files() == after
    got = {r.id: r.title for r in spark.read.parquet(path).collect()}
    assert len(got) == 102 and got[3] == "new" and got[203] == "added" and got[8] == "title 8" and got[100] == "still none"


def test_copies_count_what_fails(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([(k, None if k % 4 == 0 else f"t{k}") for k in range(20)], "id long, title string")
    assert copy_with_retries(rows.where("id < 10"), path, ("id",), F.col("title").isNotNull()) == {"copied": 7, "skipped": 0, "failed": 3}
    assert copy_with_retries(rows, path, ("id",), F.col("title").isNotNull()) == {"copied": 8, "skipped": 7, "failed": 5}
    assert spark.read.parquet(path).count() == 15


def test_bitmaps_count_as_distinct_does(spark):
    rows = [(k, None if k % 50 == 0 else f"v{k * k % 301}", 1_700_000_000 + k * 613 % 900_000) for k in range(4000)]
    r = spark.createDataFrame(rows, "id long, visitor string, epoch long")
    bucket = F.col("epoch") - F.col("epoch") % 300
    known = B.numbered(r.where("id < 1000"))
    numbers = B.numbered(r, known)
    assert numbers.join(known, ["visitor", "number"]).count() == known.count()
    assert numbers.agg(F.count_distinct("number"), F.max("number")).first() == (numbers.count(), numbers.count())
    early, late = (B.bucket_bitmaps(r.where(c), numbers, bucket) for c in ("id < 2500", "id >= 2000"))
    whole = B.merged_bitmaps(early, late)  # loads that overlap
    for span in ("bucket_epoch", "bucket_epoch div 3600", "bucket_epoch div 86400"):
        got = B.distinct_visitors(B.rolled_up(whole, F.expr(span), "at"), "at")
        want = r.withColumn("bucket_epoch", bucket).groupBy(F.expr(span).alias("at")).agg(F.count_distinct("visitor").alias("n")).where("n > 0")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    days = B.rolled_up(whole, F.expr("bucket_epoch div 86400"), "day")
    got = {x.day: x.visitors for x in B.distinct_visitors(B.trailing(days, 3), "day").collect()}
    day = {}
    for _, v, e in rows:
        if v:
            day.setdefault(e // 86400, set()).add(v)
    assert got == {d: len(set().union(*(day.get(x, set()) for x in range(d - 2, d + 1)))) for d in range(min(day), max(day) + 1)}
