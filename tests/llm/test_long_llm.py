"""Texts longer than what one numpy pass takes, beside short ones, through every operator; and ties."""

import collections
import math
import random
import zlib

import pytest
from test_groups_llm import brute_components, brute_lines, brute_print
from test_text_llm import SMALL, WORD, brute_kept, brute_quality, prose

from turnmill.llm import common, decontaminate, language_model, packing, quality, rans, simhash, substring, templates, token_counts, toxicity


@pytest.fixture(scope="module")
def long_texts():
    rng = random.Random(77)
    line = [prose(rng, 400) for _ in range(60)]
    long = "\n".join(rng.choice(line) + f" {rng.randrange(10**9)} {k}" for k in range(2200))
    assert len(long) > common.CHUNK_BYTES
    return [prose(rng, 50), long, "", prose(rng, 80), None]


@pytest.fixture(scope="module")
def long_docs(spark, long_texts):
    return spark.createDataFrame(list(enumerate(long_texts)), "doc_id long, text string").repartition(2)


def test_long_texts_are_packed_and_stored_whole(long_docs, long_texts, word_bpe, byte_bpe):
    from turnmill.llm.tokens import encoder

    ids = lambda path: {d: encoder(path).tokenizer.encode(t or "", add_special_tokens=False).ids for d, t in enumerate(long_texts)}
    words, pieces = ids(word_bpe), collections.Counter()
    for r in packing.pack_documents(long_docs, word_bpe).collect():
        pieces[r.doc_id] += r.length
        own = [*words[r.doc_id], 2][r.start : r.start + r.length]
        assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own)) == r.ids_crc32
    assert pieces == {d: len(x) + 1 for d, x in words.items()}
    by_bytes = {d: len(x) + 1 for d, x in ids(byte_bpe).items()}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(long_docs, byte_bpe, 50256).collect()} == by_bytes
    assert {r.doc_id: r.n_tokens for r in rans.encode_and_read_back(long_docs, byte_bpe, 0).collect()} == by_bytes


def test_long_texts_are_scored_whole(spark, long_docs, long_texts):
    labels = spark.createDataFrame([(0, 0), (1, 0), (3, 1)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.score_held_out(long_docs, labels).collect())
    tokens = {d: [*(w.lower() for w in WORD.findall(t or "")), ""] for d, t in enumerate(long_texts)}
    c = collections.Counter(w for d, ws in tokens.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for r in language_model.score_documents(long_docs, SMALL).collect():
        own = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known) == (len(own), sum(c[w] > 0 for w in own)) and math.isfinite(r.score)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)


def test_long_texts_are_judged_whole(long_docs, long_texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(long_docs).collect()}
    assert [got[k] for k in range(len(long_texts))] == brute_kept(long_texts, 35)
    from pyspark.sql import functions as F

    judged = {r.doc_id: r for r in quality.judge(long_docs.withColumn("lang", F.lit("en"))).collect()}
    for k, t in enumerate(long_texts):
        assert tuple(judged[k][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_quality(t)


def test_long_texts_are_deduplicated_whole(spark, long_docs, long_texts):
    prints = [brute_print(t) for t in long_texts]
    got = {r.doc_id: r for r in simhash.near_duplicates(long_docs).collect()}
    assert [got[k].fingerprint for k in range(len(prints))] == [f"{p:016x}" for p in prints]
    assert [got[k].component_id for k in range(len(prints))] == brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    near = long_docs.unionByName(spark.createDataFrame([(9, long_texts[1] + " and its own end")], "doc_id long, text string"))
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(near).collect()) == [0, 1, 2, 3]
    lines = {r.doc_id: r.text or "" for r in templates.drop_templates(long_docs, counts=None).collect()}
    assert [lines[k] for k in range(len(long_texts))] == brute_lines(long_texts)
    item = " ".join(long_texts[1].split()[-60:-10])
    hits = decontaminate.contaminated(long_docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [r.doc_id for r in hits] == [1]


def test_ties_are_settled_by_the_text(spark):
    """Words, common words and templates of equal count: the result does not depend on how rows are dealt."""
    rng = random.Random(8)
    rows = [(k, f"{prose(rng, 60)} same{k % 4} other{k % 4}\nnotice {k % 3} of equal parts in all texts here", "en") for k in range(48)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    runs = []
    for n in (1, 5):
        d = df.repartition(n)
        lm = sorted((r.doc_id, r.n_known, round(r.base_score, 9), round(r.score, 3)) for r in language_model.score_documents(d, SMALL).collect())
        q = sorted(map(tuple, quality.judge(d).select("doc_id", "kept", "word_distance").collect()))
        t = sorted(map(tuple, templates.drop_templates(d).collect()))
        runs.append((lm, q, t))
    assert runs[0] == runs[1]
