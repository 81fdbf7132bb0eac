"""The data source of stored files, and many terms in one pass."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from turnmill.functions import context
from turnmill.functions.text import markers_in
from turnmill.operators import terms as M
from turnmill.sources import objects


@pytest.fixture
def folder(spark, tmp_path):
    objects.register(spark)
    (tmp_path / "in").mkdir()
    return str(tmp_path / "in")


def _read(spark, folder, **options):
    return spark.read.format("stored_objects").options(path=folder, **options).load()


def test_files_come_back(spark, folder):
    rows = [(f"../x/na me{k}.TXT", bytes([k % 256]) * k) for k in range(40)] + [("empty.csv", None)]
    spark.createDataFrame(rows, "name string, content binary").repartition(5).write.format("stored_objects").option("path", folder).mode("append").save()
    got = {os.path.basename(r.path): r for r in _read(spark, folder, partitionbytes=5000).collect()}
    assert len(got) == 41 and got["na_me7.txt"].content == bytes([7]) * 7 and got["empty.csv"].length == 0
    assert _read(spark, folder, partitionbytes=5000).rdd.getNumPartitions() > 5
    few = _read(spark, folder, extensions="txt", maxbytes=10)
    assert few.where("accepted").count() == 11 and few.where("NOT accepted AND content IS NOT NULL").count() == 0
    assert _read(spark, folder, contents="false").where("content IS NOT NULL").count() == 0
    spark.createDataFrame([("one.txt", b"1")], "name string, content binary").write.format("stored_objects").option("path", folder).mode("overwrite").save()
    assert sorted(os.listdir(folder)) == ["one.txt"]


def test_a_failed_job_leaves_nothing(spark, folder):
    rows = [(f"f{k}.txt", b"x" * (k if k != 33 else 999)) for k in range(40)]
    with pytest.raises(Exception, match="refused"):
        spark.createDataFrame(rows, "name string, content binary").repartition(4).write.format("stored_objects").options(path=folder, maxbytes=100).mode("append").save()
    assert os.listdir(folder) == []
    assert _read(spark, folder).count() == 0


def test_terms_of_many(spark):
    rng = random.Random(5)
    terms = list(dict.fromkeys("".join(rng.choice("abcd") for _ in range(rng.randint(1, 5))) for _ in range(3000)))
    texts = ["".join(rng.choice("abcdx ") for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, ""]
    df = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "id long, text string, row long").repartition(3)
    got = {r.id: r.terms for r in M.with_terms_in(df, "text", terms).collect()}
    assert got == {k: [t for t in terms if t in (x or "")] for k, x in enumerate(texts)}
    marked = {r.id: r.html for r in M.with_marks(df, "id", "text", terms).collect()}
    assert marked == {k: context.highlight_terms(x, terms) for k, x in enumerate(texts)}
    counts = {r.term: r.n_texts for r in M.term_counts(df, "text", terms).collect()}
    assert counts == {t: n for t in terms if (n := sum(t in (x or "") for x in texts))}
    few = terms[:20]
    want = {r.id: list(r.m or []) for r in df.select("id", markers_in(F.col("text"), few).alias("m")).collect()}
    assert {r.id: r.terms for r in M.with_terms_in(df, "text", few).collect()} == want


def test_marks_are_leftmost_and_longest():
    found = M.automaton(["ab", "abc", "bcd", "d"])
    assert M.spans(found, "abcd xab") == [(0, 3), (3, 4), (6, 8)]
    assert M.spans(found, None) == M.spans(M.automaton([]), "abc") == []
    assert re.sub("<[^>]*>", "", context.mark_up("a<b", [(0, 1)])) == "a&lt;b"
