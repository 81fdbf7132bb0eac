"""Toxicity, language model, substring dedup and quality rules."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnmill.llm import language_model, quality, substring, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, extra=()):
    parts = "the and tion er in re on that ha th it es".split()
    words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)]
    for w in extra:
        words[rng.randrange(n)] = w
    return " ".join(words)


def test_subwords_are_hashed_by_content():
    s = toxicity.Settings()
    a, at = toxicity.subwords(["idiot", "ß", "idiot"], s)
    assert a[at[0] : at[1]].tolist() == a[at[2] : at[3]].tolist() and len(a[at[1] : at[2]]) == 2


def test_toxicity_learns_and_reaches_misspellings():
    rng = random.Random(3)
    bad = ["stupid", "idiot", "worthless"]
    texts = [prose(rng, 60, rng.sample(bad, 2) if k % 2 else ()) for k in range(400)]
    s = toxicity.Settings(least_documents=3)
    model = toxicity.train(pa.array(texts, pa.large_string()), np.arange(400) % 2, s)
    fresh = [prose(rng, 80, ["stupidd", "idiots", "worthlesss"] if k % 2 else ()) for k in range(100)] + [""]
    p = model.scores(pa.array(fresh, pa.large_string()))
    toxic = np.arange(100) % 2 == 1
    assert (p[:100][toxic][:, None] > p[:100][~toxic]).mean() > 0.97 and (p[:100][~toxic] < 0.5).mean() > 0.9 and 0 <= p[-1] <= 0.5


def test_toxicity_edges(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_held_out(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert toxicity.score_held_out(no_docs, labels).count() == 0
    kept = toxicity.drop_toxic(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def slow_toxicity(model, text):
    """A document's score word by word: the most toxic window of four words."""
    s = model.settings
    words = [w.lower() for w in WORD.findall(text or "")]
    each = [np.mean([float(model.share[b]) for b in toxicity.subwords([w], s)[0]]) for w in words]
    logit = max((float(np.mean(each[k : k + s.window])) + model.bias for k in range(0, len(words), s.window)), default=model.bias)
    return 1 / (1 + math.exp(-(model.slope * logit + model.offset)))


def test_toxicity_stage_against_a_slow_version(spark):
    rng = random.Random(4)
    bad = ["stupid", "idiot", "worthless"]
    rows = [(k, prose(rng, rng.randint(1, 90), bad[: 1 + k % 3] if k % 5 == 1 else ())) for k in range(150)] + [(200, None), (None, "a stupid idiot"), (201, ""), (5, "again " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 5 == 1)) for k in range(150)] + [(5, 1), (6, 7)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.dump() == toxicity.fit(docs.repartition(5), labels).dump()
    got = sorted((r.doc_id or -1, r.score) for r in toxicity.score(docs, model).collect())
    want = sorted((d or -1, slow_toxicity(model, t)) for d, t in rows)
    assert np.allclose([x[1] for x in got], [x[1] for x in want], atol=1e-5)
    kept = sorted((r.doc_id or -1, r.text or "") for r in toxicity.drop_toxic(docs, labels).collect())
    assert kept == sorted((d or -1, t or "") for d, t in rows if slow_toxicity(model, t) < 0.5) and len(kept) < len(rows)


def test_toxicity_sample_is_bounded_by_rows_and_bytes(spark):
    rows = [(k % 3, f"text {k} " * 10) for k in range(90)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, 0), (1, 1), (2, 0)], "doc_id long, toxic int")
    seen = [toxicity.sample(docs, labels, s).toPandas() for s in (toxicity.Settings(rows_each=10), toxicity.Settings(rows_each=10, class_bytes=300))]
    assert seen[0]["toxic"].value_counts().max() <= 10 and len(seen[1])
    assert seen[1].groupby("toxic")["text"].agg(lambda x: x.str.len().sum()).max() <= 300


def test_toxicity_sample_keeps_all_that_fit(spark):
    """A text too long for the bound takes no other's place, and near copies and texts that share a phrase all train."""
    rng = random.Random(6)
    phrase = "the people of the city went to the market in the morning"
    rows = [(k, f"{phrase} {prose(rng, 30)} {'you are an idiot' if k % 4 == 1 else 'good day'}") for k in range(400)]
    rows += [(400 + k, rows[k][1] + " again") for k in range(0, 40, 2)] + [(500, "long word " * 1_400_000)]
    labels = spark.createDataFrame([(d, int(d % 4 == 1)) for d, _ in rows], "doc_id long, toxic int")
    got = {r.text for r in toxicity.sample(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert got == {t for d, t in rows if zlib.crc32(str(d).encode()) % 5 and d != 500}


SMALL = language_model.Settings(words=40, words_a_root=0.1, endings=4, state=6, head=60, head_one_in=1, shard_tokens=400, epochs=2, lanes=8, span=5, updates=4, score_lanes=3)


def lm_docs(spark):
    rng = random.Random(5)
    rows = [(k, prose(rng, rng.randint(0, 60))) for k in range(80)] + [(100, None), (None, "THE and"), (7, "twice"), (7, "twice"), (101, "unseen " * 30)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_language_model_base_and_copies(spark, no_docs):
    rows = [(r.doc_id, [w.lower() for w in WORD.findall(r.text or "")] + [""]) for r in lm_docs(spark).collect()]
    out = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 == 2
    c = collections.Counter(w for d, ws in rows if not out(d) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((d or -1, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in rows)
    got = language_model.score_documents(lm_docs(spark), SMALL).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert len({r.score for r in got if r.doc_id == 7 and r.n_tokens == 2}) == 1
    assert language_model.score_documents(no_docs, SMALL).count() == 0


def test_language_model_trains_on_all_documents(spark):
    rows = [(k, f"word{k} " * 20) for k in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, shards = language_model.dealt(df, 21 * 5000, SMALL)
    assert shards == math.ceil(21 * 5000 / 400) and sorted(r.text for r in got.collect()) == sorted(t for _, t in rows)


def test_heavy_shards_of_the_language_model_are_trained_whole(monkeypatch):
    seen = []
    monkeypatch.setattr(language_model.Network, "train", lambda net, docs, epochs, rate: seen.append(sum(map(len, docs))))
    texts = ["long text " * 2500, *["equal rows here"] * 700, "other shard"]
    batch = pa.RecordBatch.from_arrays([pa.array([3] * 701 + [4]), pa.array(texts)], names=["shard", "text"])
    out = list(language_model.learner(["long", "text", ""], np.ones(3 + SMALL.endings), SMALL, None, 1, 0.01)(iter([batch])))
    n = 5001 + 700 * 4 + 3
    assert sum(seen) == n == out[0].column("weight")[0].as_py() and max(seen) == 2 * SMALL.shard_tokens and seen[-1] == 3


def test_probabilities_sum_to_one_and_state_is_carried():
    v = language_model.Vocabulary([f"w{i}" for i in range(29)] + [""], list(range(40, 10, -1)), SMALL)
    net = language_model.Network(v, np.ones(v.size))
    h = np.random.default_rng(0).standard_normal((3, SMALL.state)).astype(np.float32)
    p = sum(np.exp(net.log_probabilities(h, np.full(3, i))) for i in range(v.size))
    assert p == pytest.approx([1, 1, 1], abs=1e-4)
    ids, at = np.array([1, 2, 3, 4, 29, 5, 29]), np.array([0, 5, 7])
    together = net.score(ids, at)
    alone = [net.score(ids[a:b], np.array([0, b - a]))[0] for a, b in itertools.pairwise(at.tolist())]
    assert together == pytest.approx(alone, rel=1e-5)


def test_large_logits_stay_finite():
    v = language_model.Vocabulary([f"w{i}" for i in range(9)] + [""], list(range(20, 10, -1)), SMALL)
    net = language_model.Network(v, np.ones(v.size))
    net.p["bc"][:2], net.p["bw"][:] = (500, -500), np.linspace(-900, 900, 10)
    h = np.zeros((4, SMALL.state), np.float32)
    assert np.isfinite(net.log_probabilities(h, np.array([0, 5, 9, 11]))).all()
    g = {k: np.zeros(x, np.float32) for k, x in net.shapes.items()}
    assert np.isfinite(net.gradients(h, np.array([0, 5, 9, 11]), g)).all() and all(np.isfinite(x).all() for x in g.values())


def test_gradients_by_differences():
    v = language_model.Vocabulary([f"w{i}" for i in range(9)] + [""], list(range(20, 10, -1)), SMALL)
    net = language_model.Network(v, np.ones(v.size))
    rng = np.random.default_rng(1)
    net.all += rng.standard_normal(net.n).astype(np.float32) * 0.3
    steps, lanes = 4, 3
    y = rng.integers(0, v.size, (steps, lanes))
    x = np.concatenate([np.full((1, lanes), 9), y[:-1]])
    fresh = x == 9
    fresh[2, 1] = True
    start = rng.standard_normal((lanes, SMALL.state)).astype(np.float32)

    def loss():
        h, total = start, 0.0
        for k in range(steps):
            h = net.step(net.p["in"][x[k]], np.where(fresh[k][:, None], np.float32(0), h))[0]
            total -= net.log_probabilities(h, y[k]).sum()
        return total / y.size

    grad = np.zeros(net.n, np.float32)
    net.span(x, y, fresh, start.copy(), grad)
    for i in rng.choice(net.n, 250, replace=False):
        old = net.all[i]
        net.all[i] = old + 1e-2
        up = loss()
        net.all[i] = old - 1e-2
        down = loss()
        net.all[i] = old
        assert (up - down) / 2e-2 == pytest.approx(grad[i], abs=2e-3)


def test_training_learns_what_follows():
    v = language_model.Vocabulary([f"w{i}" for i in range(9)] + [""], list(range(20, 10, -1)), SMALL)
    rng = np.random.default_rng(2)
    docs = [np.append((np.arange(30) + rng.integers(9)) % 9, 9) for _ in range(200)]
    net = language_model.Network(v, np.ones(v.size))
    ids, at = np.concatenate(docs), np.arange(0, 31 * 201, 31)
    before = net.score(ids, at).mean() / 31
    net.train(docs, 6, 0.05)
    assert net.score(ids, at).mean() / 31 > before / 3


def slow_score(text, net, counts, endings, types, settings):
    """log10 of a text's probability, token by token, in plain floats."""
    p, v = {k: x.astype(float) for k, x in net.p.items()}, net.v
    n, h, last, total = settings.state, np.zeros(settings.state), v.place[""], 0.0
    for w in [*(x.lower() for x in WORD.findall(text or "")), ""]:
        x, g = p["in"][last], h @ p["u"]
        z, r = (1 / (1 + np.exp(-(x[a : a + n] + g[a : a + n]))) for a in (0, n))
        h = z * h + (1 - z) * np.tanh(x[2 * n :] + r * g[2 * n :])
        e = zlib.crc32(w[-2:].encode()) % settings.endings
        last = v.place.get(w, len(v.words) + e)
        logit = p["wc"] @ h + p["bc"]
        c = v.class_of[last]
        total += logit[c] - math.log(sum(math.exp(y) for y in logit))
        if w in v.place:
            inner = p["ww"] @ h + p["bw"]
            total += inner[last] - math.log(sum(math.exp(inner[k]) for k in range(len(v.words)) if v.class_of[k] == c))
        else:
            total += math.log((counts[w] + 1) / (endings[e] + types[e] + 1))
    return total / math.log(10)


def test_scores_equal_a_slow_version(spark, monkeypatch):
    rows = lm_docs(spark).collect()
    out = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 == 2
    c = collections.Counter(w for r in rows if not out(r.doc_id) for w in [*(x.lower() for x in WORD.findall(r.text or "")), ""])
    made = {}

    def fixed(training, v, counts, n_tokens, scratch):
        made["net"] = language_model.Network(v, counts)
        made["net"].all += np.random.default_rng(4).standard_normal(made["net"].n).astype(np.float32) * 0.3
        return made["net"].all.copy()

    monkeypatch.setattr(language_model, "train", fixed)
    got = language_model.score_documents(lm_docs(spark), SMALL).collect()
    # words of equal count are taken in their own order
    n_words = max(SMALL.words, int(SMALL.words_a_root * math.sqrt(len(c))))
    assert made["net"].v.words == sorted(c, key=lambda w: (w != "", -c[w], w))[:n_words]
    rest = [w for w in c if w not in made["net"].v.place]
    endings, types = collections.Counter(), collections.Counter()
    for w in rest:
        e = zlib.crc32(w[-2:].encode()) % SMALL.endings
        endings[e] += c[w]
        types[e] += 1
    want = sorted((r.doc_id or -1, slow_score(r.text, made["net"], c, endings, types, SMALL)) for r in rows)
    found = sorted((r.doc_id or -1, r.score) for r in got)
    assert rest and [x[0] for x in found] == [x[0] for x in want] and np.allclose([x[1] for x in found], [x[1] for x in want], rtol=1e-4)


def brute_kept(texts, window):
    docs = [WORD.findall(t or "") for t in texts]
    c = collections.Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    out = []
    for w in docs:
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if c[tuple(w[i : i + window])] > 1:
                keep[i : i + window] = [False] * window
        left = [x for x, k in zip(w, keep) if k]
        out.append((len(w), len(w) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("limit,bits", [(20_000, 27), (2, 16)])
def test_substring_against_brute_force(spark, limit, bits):
    rng = random.Random(9)
    shared = prose(rng, 30)
    texts = [prose(rng, rng.randint(0, 40)) for _ in range(30)] + [f"{prose(rng, 5)} {shared} {prose(rng, 4)}" for _ in range(6)] + ["x " * 40, "x " * 13, shared, shared, None, "", "é ü " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(df, window=12, mer=4, bits=bits, limit=limit).collect()}
    assert [got[i] for i in range(len(texts))] == brute_kept(texts, 12)


def test_substring_edges(odd_docs, no_docs):
    got = substring.remove_repeats(odd_docs, window=3, mer=2).collect()
    rows = odd_docs.collect()
    want = sorted((r.doc_id or -1, *k) for r, k in zip(rows, brute_kept([r.text for r in rows], 3)))
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert substring.remove_repeats(no_docs).count() == 0


def brute_quality(text):
    w = WORD.findall(text or "")
    c = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j + k for j in range(len(w) - 2) if c[w[j], w[j + 1], w[j + 2]] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, odd_docs, no_docs):
    got = quality.judge(odd_docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))).collect()
    want = sorted((r.doc_id or -1, *brute_quality(r.text)) for r in odd_docs.collect())
    assert sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    assert quality.judge(no_docs).count() == 0


def test_quality_rejects_noise_and_keeps_prose(spark):
    rng = random.Random(2)
    rows = [(k, prose(rng, 200)) for k in range(60)] + [(100, " ".join(f"{w}###" for w in prose(rng, 200).split()))]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))).collect()}
    assert not kept.pop(100) and all(kept.values())


def test_js_distance(spark):
    r = spark.sql("SELECT array(1L, 0L) a, array(0L, 5L) b, array(0L, 0L) z").select(quality.js_distance(F.col("a"), F.col("b")), quality.js_distance(F.col("a"), F.col("a")), quality.js_distance(F.col("a"), F.col("z"))).first()
    assert r[0] == pytest.approx(1) and r[1] == pytest.approx(0) and r[2] is None


@pytest.mark.parametrize("name", ["op5_substring", "op6_quality"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    from turnmill.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df().sort_values("doc_id")
    got = queries.queries()[name](spark, sf).toPandas().sort_values("doc_id")
    assert sorted(got.columns) == sorted(want.columns)
    for c in want.columns:
        assert got[c].tolist() == want[c].tolist()
