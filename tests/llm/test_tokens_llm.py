"""Tokenizers, packing, token counts and token files."""

import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnmill.llm import packing, rans, token_counts
from turnmill.llm.tokens import encoder

TEXT = st.text(st.sampled_from("ab'stI.,!? \n\t\x00 　éß1́<|>"), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name, texts):
    import public_tokenizers

    e = encoder(public_tokenizers.path(name))
    ids, at = e.encode(pa.array(texts, pa.large_string()))
    for i, x in enumerate(e.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == x.ids


def library_ids(path, text, end):
    return [*encoder(path).tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def test_packing_whole(spark, odd_docs, word_bpe):
    got = packing.pack_documents(odd_docs.repartition(2), word_bpe, costs=packing.Costs(window=64)).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for rows in by_seq.values():
        rows.sort(key=lambda r: r.offset)
        assert rows[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in pairwise(rows))
        assert sum(r.length for r in rows) <= 64
    want = [(r.doc_id, library_ids(word_bpe, r.text, 2)) for r in odd_docs.collect()]
    assert sum(r.length for r in got) == sum(len(x) for _, x in want)
    for doc, ids in want:
        rows = [r for r in by_doc[doc, len(ids)]]
        assert {s for r in rows for s in range(r.start, r.start + r.length)} == set(range(len(ids)))
        assert any(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in rows)


def test_packing_empty(no_docs, word_bpe):
    assert packing.pack_documents(no_docs, word_bpe).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 20)), min_size=1, max_size=14))
def test_cuts_cost_least(steps):
    position = np.cumsum([0, *[a for a, _ in steps]])
    penalty = np.array([0, *[b for _, b in steps[:-1]], 0], float)
    n, window = len(position), 12

    def cost(cuts):
        return sum((window - (position[b] - position[a])) * (b < n - 1) + penalty[b] for a, b in pairwise(cuts))

    best = {0: 0.0}
    for i in range(1, n):
        best[i] = min(best[j] + (window - (position[i] - position[j])) * (i < n - 1) + penalty[i] for j in range(i) if position[i] - position[j] <= window)
    cuts = packing.best_cuts(position, penalty, window)
    assert all(position[b] - position[a] <= window for a, b in pairwise(cuts)) and cost(cuts) == pytest.approx(best[n - 1])


def test_token_counts(spark, odd_docs, byte_bpe, no_docs):
    got = token_counts.count_tokens(odd_docs.repartition(3), byte_bpe, 50256, block_ids=7).collect()
    want = sorted((r.doc_id or -1, len(library_ids(byte_bpe, r.text, 0))) for r in odd_docs.collect())
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == want
    for file in {r.file_no for r in got}:
        rows = sorted((r.start, r.n_tokens) for r in got if r.file_no == file)
        assert rows[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in pairwise(rows))
    assert token_counts.count_tokens(no_docs, byte_bpe, 50256).count() == 0


def test_scan_ends_an_open_document(spark):
    rows = [(0, 0, np.array([5, 9, 1], "<u2").tobytes()), (0, 1, np.array([2, 3, 4], "<u2").tobytes()), (0, 2, np.array([9, 8], "<u2").tobytes())]
    flat = spark.createDataFrame([(*r, None, None) for r in rows], token_counts.FLAT)
    got = sorted((r.doc_no, r.start, r.n_tokens) for r in token_counts.scan_blocks(flat, 9, block_ids=3).collect())
    assert got == [(0, 0, 2), (1, 2, 5), (2, 7, 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=300), st.integers(1, 3))
def test_section_round_trip(ids, lanes):
    lengths = [len(ids)] if ids else []
    raw = rans.encode_section(np.array(ids, np.uint32), [None] * len(lengths), np.array(lengths, int), 0, lanes=lanes, steps=8, stretches=2)
    back, docs, n = rans.decode_section(raw)
    assert back.tolist() == ids and docs == [None] * len(lengths) and n.tolist() == lengths


def test_damage_is_found():
    raw = bytearray(rans.encode_section(np.arange(500, dtype=np.uint32) % 7, [1], np.array([500]), 0))
    raw[-3] ^= 1
    with pytest.raises(rans.Corrupt):
        rans.decode_section(bytes(raw))
    with pytest.raises(rans.Corrupt):
        rans.decode_section(b"x" * 200)


def test_token_files(odd_docs, byte_bpe, no_docs):
    got = rans.encode_and_read_back(odd_docs, byte_bpe, 0).collect()
    got.sort(key=lambda r: r.start)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    want = sorted((zlib.crc32(np.array(x := library_ids(byte_bpe, t, 0), "<u4").tobytes()), len(x)) for _, t in rows)
    assert sorted((r.ids_crc32, r.n_tokens) for r in got) == want
    assert got[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in pairwise(got))
    assert rans.encode_and_read_back(no_docs, byte_bpe, 0).count() == 0


def test_ids_that_flat_files_cannot_hold(spark, byte_bpe):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for end in (library_ids(byte_bpe, "a b", 0)[0], 70_000):
        with pytest.raises(Exception) as caught:
            token_counts.count_tokens(docs, byte_bpe, end).collect()
        assert "is also an id of a text" in str(caught.value) or "does not fit" in str(caught.value)


def test_files_of_rows_without_ids(spark, byte_bpe):
    docs = spark.createDataFrame([(None, f"text {k}") for k in range(200)] + [(5, "a"), (5, "b")], "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one file
    sections = rans.write_sections(docs, byte_bpe, 0, rans.Scratch(spark, "t"), section_ids=50)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sections.select("file_no").distinct().count() > 1
    got = rans.read_sections(sections).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 200 + [5, 5] and got[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in pairwise(got))
