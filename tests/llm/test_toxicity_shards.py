"""The toxicity model learns from every labelled row, in shards of bounded size."""

import random

import numpy as np
from pyspark.sql import functions as F
from test_text_llm import prose, slow_toxicity

from turnmill.llm import toxicity


def labelled_texts(spark, n=600):
    rng = random.Random(8)
    bad = ["stupid", "idiot", "worthless"]
    rows = [(k, prose(rng, rng.randint(20, 60), rng.sample(bad, 2) if k % 4 == 1 else ())) for k in range(n)]
    rows += [(n, prose(rng, 3000, bad * 40)), (None, "a stupid idiot"), (n + 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return rows, docs, spark.createDataFrame([(d, int(d % 4 == 1 or d == n)) for d, _ in rows if d is not None], "doc_id long, toxic int")


def test_the_bounds_of_a_sample_do_not_bound_what_is_learnt(spark):
    rows, docs, labels = labelled_texts(spark, 80)
    few = toxicity.Settings(rows_each=2, class_bytes=10)
    assert toxicity.fit(docs, labels, few).dump() == toxicity.fit(docs, labels).dump()
    got = {r.doc_id for r in toxicity.labelled(docs.unionByName(docs), labels).collect()}
    ids = docs.where(~toxicity.held_out(F.col("doc_id"))).collect()
    assert got == {r.doc_id for r in ids} and toxicity.labelled(docs.unionByName(docs), labels).count() == len(ids)


def test_shards_of_all_rows_make_one_model(spark):
    rows, docs, labels = labelled_texts(spark)
    s = toxicity.Settings(shard_bytes=20_000, piece_bytes=3000, least_documents=3)
    model = toxicity.fit(docs, labels, s)
    assert model.dump() == toxicity.fit(docs.repartition(5), labels, s).dump() and model.slope > 0
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    got = [(r.score, toxic[r.doc_id]) for r in toxicity.score_held_out(docs, labels, s).where("held_out AND doc_id IS NOT NULL").collect()]
    assert np.mean([a > b for a, x in got if x for b, y in got if not y]) > 0.95
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert np.allclose([scores[d] for d, _ in rows[:50]], [slow_toxicity(model, t) for _, t in rows[:50]], atol=1e-5)


def test_long_texts_are_cut_where_windows_begin(spark):
    rows, docs, labels = labelled_texts(spark)
    s = toxicity.Settings(piece_bytes=100)
    found = {}
    for r in toxicity._pieces(toxicity.labelled(docs, labels), s).collect():
        found.setdefault(r.doc_id, {})[r.piece] = r.text.split()
    for d, pieces in found.items():
        text = next(t for k, t in rows if k == d) or ""
        assert sum((pieces[k] for k in sorted(pieces)), []) == text.split()
        assert all(len(pieces[k]) % s.window == 0 for k in sorted(pieces)[:-1])
