"""SimHash, templates, decontamination and the pipeline."""

import itertools
import random
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from test_text_llm import WORD, prose

from turnmill.llm import bitmap, decontaminate, simhash, templates
from turnmill.llm.common import Scratch


def brute_print(text, words=3):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = WORD.findall(low)
    sh = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, near):
    up = list(range(len(values)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(values)), 2):
        if near(values[i], values[j]):
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def near_texts():
    rng = random.Random(4)
    base = [prose(rng, 150) for _ in range(12)]
    out = list(base)
    for t in base[:8]:
        for _ in range(4):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    return [*out, base[0], "", "  ", "a", "A", "a b"]


@pytest.mark.parametrize("limit", [2048, 3])
def test_simhash_against_brute_force(spark, limit):
    texts = near_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in simhash.near_duplicates(df, limit=limit).collect()}
    prints = [brute_print(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(texts))] == brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)


def test_simhash_of_odd_documents(spark, odd_docs, no_docs):
    """Null ids and texts, blanks, repeated rows and further columns."""
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    prints = [brute_print(t) for _, t in rows]
    roots = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = lambda i: min((rows[j][0] for j in range(len(rows)) if roots[j] == roots[i] and rows[j][0] is not None), default=None)
    key = lambda r: tuple(map(str, r))
    got = simhash.near_duplicates(odd_docs).collect()
    assert sorted(map(tuple, got), key=key) == sorted(((d, f"{p:016x}", least(i)) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=key)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_rows_equal_in_id_and_text_leave_the_same_one(spark):
    rows = [(1, "some text of words", k, {"k": str(k)}) for k in range(6)] + [(2, None, 7, None), (2, None, 8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, m map<string,string>")
    kept = [sorted((r.doc_id, r.n) for r in simhash.drop_near_duplicates(df.repartition(n)).collect()) for n in (1, 3, 7)]
    assert kept[0] == kept[1] == kept[2] and [d for d, _ in kept[0]] == [1, 2]


def test_shards_lose_no_pair(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = list({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(6)})
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fingerprint long")
    met: dict = {}
    for r in simhash.shards(df, 3, Scratch(spark, "t"), limit=4).collect():
        met.setdefault(r.shard, set()).add(r.fingerprint & (1 << 64) - 1)
    together = {frozenset(p) for s in met.values() for p in itertools.combinations(s, 2)}
    assert all(frozenset((a, b)) in together for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 255), max_size=40), st.integers(0, 255), st.integers(0, 4))
def test_bk_tree(values, q, radius):
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    assert sorted(tree.within(q, radius)) == sorted(v for v in set(values) if (v ^ q).bit_count() <= radius)


def test_components_on_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(5, 5)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 130)}
    assert simhash.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_near_duplicate_stage(spark, odd_docs, no_docs):
    texts = near_texts()
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, row string")
    kept = sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect())
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in (WORD.findall(t.lower()) for t in texts)]
    root = brute_components(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    assert kept == sorted(set(root))
    out = simhash.drop_near_duplicates(odd_docs)
    assert out.columns == odd_docs.columns and out.where("doc_id = 3").count() == 1
    assert simhash.drop_near_duplicates(no_docs).count() == 0


def edited_texts(groups, copies):
    """Groups of texts with five-word Jaccard similarities of about 0.6 to 0.95 to the first."""
    rng = random.Random(31)
    out = []
    for g in range(groups):
        base = prose(rng, 120).split()
        out.append(" ".join(base))
        for _ in range(copies):
            w = list(base)
            for k in rng.sample(range(120), rng.randint(1, 6)):
                w[k] = f"edit{rng.randrange(10**6)}"
            out.append(" ".join(w))
    return out


def exact_groups(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in (WORD.findall(t.lower()) for t in texts)]
    return sorted(set(brute_components(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))))


def test_near_duplicates_are_confirmed_exactly(spark):
    texts = [*edited_texts(40, 3), *[f"{'one two three four five six seven ' * n}end" for n in (3, 9)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect()) == exact_groups(texts)


@pytest.mark.parametrize("limit,few", [(1, 32), (3, 1), (10, 4), (2048, 1), (2048, 32)])
def test_hot_shards_lose_no_near_duplicate(spark, limit, few):
    texts = edited_texts(2, 40)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    scratch = Scratch(spark, "t")
    keys, linked = simhash.similar_texts(df, scratch, 5, 0.8, limit, few)
    of, ids = {r.node: r.root for r in linked.collect()}, {r.doc_id: r.tkey for r in keys.collect()}
    first: dict = {}
    for d in sorted(ids):
        first.setdefault(of.get(ids[d], ids[d]), d)
    assert sorted(first.values()) == exact_groups(texts)


def test_hot_shards_are_cut_and_lose_no_pair(spark):
    rows = [(s, k, 1 if k < n else k % 7 + 2) for s, n, size in ((5, 40, 60), (6, 3, 5), (7, 9, 9), (8, 2, 30)) for k in range(size)]
    met, parts = set(), {}
    for r in simhash.deal_hot(spark.createDataFrame(rows, "shard long, node long, root long"), 6).collect():
        parts.setdefault(r.shard, []).append((int(r.shard.split(".")[0]), r.node))
    for x in parts.values():
        met |= set(itertools.combinations(sorted(x), 2))
    want = {((s, a), (s, b)) for s, a, x in rows for t, b, y in rows if s == t and a < b and x != y}
    assert want <= met and max(map(len, parts.values())) < 30


@pytest.mark.parametrize("bits", [16, 20])
def test_bitmap(spark, bits):
    rng = np.random.default_rng(bits)
    inside = rng.integers(-(1 << 63), (1 << 63) - 1, 500)
    df = spark.createDataFrame([(int(x),) for x in [*inside, 0, -1]], "h long")
    raw = np.frombuffer(bitmap.build(df, "h", bits), np.uint8)
    assert bitmap.test(raw, np.array([*inside, 0, -1], np.int64).view(np.uint64), bits).all()
    other = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    known = {int(x) & (1 << bits) - 1 for x in [*inside, 0, -1]}
    assert bitmap.test(raw, other, bits).tolist() == [int(x) & (1 << bits) - 1 in known for x in other]


def test_template_leaf_generalises():
    leaf = templates.Leaf(0.7, 3)
    a = leaf.place("user bob logged in from home today again now ok".split())
    assert leaf.place("user eve logged in from work today again now ok".split()) == a
    assert leaf.place("user eve did not pay the bill for it ok".split()) != a
    assert leaf.templates[a].count(templates.FIELD) == 2


def test_templates_drop_notices_and_spare_copies(spark, odd_docs, no_docs):
    rng = random.Random(6)
    notice = lambda k: f"Printed on page {k} of this report"
    texts = [f"{prose(rng, 12)}\n{notice(k)}\n{prose(rng, 9)}" for k in range(20)] + ["copied line number one here\nand a second line of it"] * 20
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, row string").repartition(3)
    got = {r.doc_id: r for r in templates.drop_templates(df).collect()}
    for i, t in enumerate(texts):
        want = t if i >= 20 else "\n".join(x for k, x in enumerate(t.split("\n")) if k != 1)
        assert got[i].text == want and got[i].n_dropped == (i < 20)
    out = templates.drop_templates(odd_docs)
    assert out.drop("n_lines", "n_dropped").columns == odd_docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in out.collect()) == sorted((r.doc_id or -1, r.text or "") for r in odd_docs.collect())
    assert templates.drop_templates(no_docs).count() == 0


def dropped(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: r.text for r in templates.drop_templates(df).collect()}


def test_templates_count_groups_of_near_copies(spark):
    rng = random.Random(16)
    line, base = "a line that many texts hold", [prose(rng, 12) for _ in range(12)]
    block = ["first line of the notice", "its second line stands here", "and its third line follows", "the fourth one ends it"]
    texts = [f"{prose(rng, 40)}\n{line}\n{prose(rng, 40)}" for _ in range(12)]  # 0 to 11, and many copies of one more
    texts += ["\n".join([*base[:6], line, *base[6:11], prose(rng, 9)]) for _ in range(40)]
    texts += ["\n".join([prose(rng, 30), *block]) for _ in range(20)]  # 52 to 71: a block at the end
    own = [prose(rng, 12) for _ in range(13)]
    for k in range(12):  # 72 to 83: near copies, the neighbours of a line edited
        texts.append("\n".join([*own[:k], f"changed{'abcdefghijkl'[k]} {own[k]}", *own[k + 1 :]]))
    got = dropped(spark, texts)
    assert not any(line in x for x in got.values())
    assert all(got[k] == texts[k].split("\n")[0] for k in range(52, 72))
    assert all(got[k] == texts[k] for k in range(72, 84)) and all(base[0] in got[k] for k in range(12, 52))


def test_long_lines_recur_sooner_than_short_ones(spark):
    rng = random.Random(26)
    long, middle, short, pair = prose(rng, 25), prose(rng, 10), "not a long line at all", "two words"
    around = lambda x: f"{prose(rng, 60)}\n{x}\n{prose(rng, 60)}"
    texts = [around(long) for _ in range(2)] + [around(middle) for _ in range(3)] + [around(short) for _ in range(7)] + [around(pair) for _ in range(34)]
    texts += [around("12") for _ in range(34)]
    once = [prose(rng, 30) for _ in range(6)]
    texts += ["\n".join(once), "\n".join([*once[:3], "more", *once[3:]])]  # near copies of one another
    got = dropped(spark, texts)
    for k, t in enumerate(texts):
        gone = k < 5 or 12 <= k < 46
        assert got[k] == ("\n".join(t.split("\n")[::2]) if gone else t)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
    return row[-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=12), st.lists(st.sampled_from("abcde"), max_size=15))
def test_common_subsequence(unit, words):
    masks: dict[str, int] = {}
    for i, w in enumerate(unit):
        masks[w] = masks.get(w, 0) | 1 << i
    assert decontaminate.common_subsequence(masks, len(unit), words) == lcs(unit, words)


def test_latent_directions_hold_what_the_svd_holds(spark):
    rng = np.random.default_rng(0)
    base = np.abs(rng.standard_normal((40, 12))) @ np.abs(rng.standard_normal((12, 90))) * (rng.random((40, 90)) < 0.4)
    unit = np.arange(40) % 3 > 0
    rows = [(np.flatnonzero(x).tolist(), x[x != 0].tolist(), bool(u)) for x, u in zip(base, unit)] + [([], [], False)]
    s = decontaminate.Settings(rank=12, energy=1.0, rounds=4)
    terms, v = decontaminate.latent_directions(spark.createDataFrame(rows, decontaminate.ROW).repartition(3), s)
    assert terms.tolist() == sorted({t for r in rows if r[2] for t in r[0]})
    scale = np.sqrt(s.fit_weight * unit.sum() / (len(rows) - unit.sum()))
    a = (base * np.where(unit, 1, scale)[:, None])[:, terms]
    best = (np.linalg.svd(a)[1][:12] ** 2).sum()
    assert np.allclose(v.T @ v, np.eye(12), atol=1e-4) and np.linalg.norm(a @ v) ** 2 >= 0.99 * best


def test_decontamination(spark, odd_docs, no_docs):
    rng = random.Random(12)
    items = [prose(rng, rng.randint(18, 90)) for _ in range(12)]
    docs = [prose(rng, 120) for _ in range(60)]
    for k in range(10):
        docs[k] = f"{prose(rng, 40)} {items[k].upper() if k % 2 else items[k]} {prose(rng, 30)}"
    w = items[10].split()
    w[3], w[9] = "other", "words"
    docs[10] = f"{prose(rng, 30)} {' '.join(w)} {prose(rng, 50)}"
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame([*enumerate(items), (50, None), (51, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()}
    assert got == {(k, k) for k in range(11)}
    for s in (decontaminate.Settings(), decontaminate.Settings(units_a_scan=4)):  # one scan, several scans
        assert sorted(r.doc_id for r in decontaminate.drop_contaminated(d, b, s).collect()) == list(range(11, 60))
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b, s).collect()} == got
    assert decontaminate.contaminated(no_docs, b).count() == 0 and decontaminate.contaminated(d, b.where("item_id > 49")).count() == 0
    kept = decontaminate.drop_contaminated(odd_docs, b)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_decontamination_keeps_null_and_large_ids(spark):
    rng = random.Random(13)
    text = prose(rng, 40)
    large = (1 << 53) + 1
    d = spark.createDataFrame([(None, text), (large, text), (large, text), (1, None)], "doc_id long, text string")
    b = spark.createDataFrame([(None, text), (large, text), (None, None), (large, text)], "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.item_id or 0) for r in decontaminate.contaminated(d, b).collect()))
    assert got == sorted([(0, 0), (0, large), *[(large, 0), (large, large)] * 2])
    assert decontaminate.drop_contaminated(d, b).collect()[0].doc_id == 1


def paraphrases(rng, items):
    """(kind, item, text) of an item inside other prose."""
    for k, item in enumerate(items):
        w = item.split()
        half = len(w) // 2
        fewer = [x if rng.random() > 0.25 else prose(rng, 1) for x in w]
        third, fifths = list(w), list(w)
        for j in rng.sample(range(len(w)), len(w) // 3):
            third[j] = prose(rng, 1)
        for j in rng.sample(range(len(w)), len(w) * 2 // 5):
            fifths[j] = prose(rng, 1)
        longer = [y for x in w for y in ([x, prose(rng, 1)] if rng.random() < 0.3 else [x])]
        for kind, words in (("verbatim", w), ("swapped", w[half:] + w[:half]), ("a quarter replaced", fewer), ("a third replaced", third), ("two fifths replaced", fifths), ("words put in", longer)):
            yield kind, k, f"{prose(rng, 40)} {' '.join(words)} {prose(rng, 40)}"


def test_recall_of_paraphrases_and_against_all_pairs(spark):
    rng = random.Random(14)
    items = [prose(rng, rng.randint(24, 70)) for _ in range(20)]
    planted = list(paraphrases(rng, items))
    texts = [t for _, _, t in planted] + [prose(rng, 150) for _ in range(150)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()}
    found = {kind: sum((i, k) in got for i, (name, k, _) in enumerate(planted) if name == kind) for kind in dict.fromkeys(x[0] for x in planted)}
    assert all(n >= 18 for n in found.values()), found
    assert not any(i >= len(planted) for i, _ in got)
    # all pairs: no candidate search, only the checks, at every place of each text
    s = decontaminate.Settings()
    idf, _ = decontaminate.document_frequencies(d, s)
    units = [(r.item_id, list(r.words)) for r in decontaminate.benchmark_units(b, s).collect()]
    terms = np.unique(np.concatenate([decontaminate._slots(w, s.frequency_bits) & ((1 << s.term_bits) - 1) for _, w in units]))
    one = decontaminate.Units(units, terms, np.eye(len(terms), dtype=np.float32), idf, s)
    want = set()
    for i, t in enumerate(texts):
        words = t.split()
        for u, (item, unit) in enumerate(units):
            for at in range(0, max(1, len(words) - s.passage + s.stride), s.stride):
                near = words[max(0, at - len(unit)) : at + s.passage + len(unit)]
                share = max(lcs(unit, near), lcs(unit[: len(unit) // 2], near) + lcs(unit[len(unit) // 2 :], near)) / len(unit)
                if one.holds(u, share, near, s):
                    want.add((i, item))
    assert got <= want and len(got) >= 0.9 * len(want)


def tokens_of(line):
    return ["<*>" if any(c.isdigit() for c in t) else t for t in line.split()]


def brute_templates(lines, share=0.7):
    """The template of each line, in order: that which agrees in most places, the first of equal ones, if in enough; all are compared."""
    made, out = [], []
    for tokens in lines:
        same = [sum(x in (y, "<*>") for x, y in zip(t, tokens)) for t in made]
        best = max(range(len(made)), key=lambda k: (same[k], -k), default=-1)
        if best >= 0 and same[best] >= share * len(tokens):
            made[best] = [x if x == y else "<*>" for x, y in zip(made[best], tokens)]
        else:
            made.append(list(tokens))
            best = len(made) - 1
        out.append(best)
    return out, made


def brute_lines(texts, groups):
    """Line dedup in one process; groups[i] is the group of near copies of text i."""
    texts, leaves, gone = [t or "" for t in texts], {}, set()
    for t, g in zip(texts, groups):
        for line in t.split("\n"):
            tokens = tokens_of(line)
            if tokens and not (len(tokens) < 3 and set(tokens) == {"<*>"}):
                leaves.setdefault((len(tokens), *tokens[:3]), {}).setdefault(tuple(tokens), set()).add(g)
    for (n, *_), lines in leaves.items():
        ordered = sorted(lines, key=lambda x: (-len(lines[x]), "\x1f".join(x)))
        need = 2 if n > 20 else 3 if n > 7 else 8 if n > 2 else 32
        which, _ = brute_templates(ordered)
        for k in set(which):
            found = [x for x, w in zip(ordered, which) if w == k]
            if len(set().union(*(lines[x] for x in found))) >= need:
                gone.update(found)
    return ["\n".join(x for x in t.split("\n") if tuple(tokens_of(x)) not in gone) for t in texts]


def test_leaf_index_finds_what_comparing_all_finds():
    """Small vocabularies, so that templates share blocks, get fields, and tie."""
    rng = random.Random(21)
    for n, kinds, count in ((3, 2, 20), (4, 3, 40), (6, 3, 80), (10, 3, 120), (10, 12, 120), (25, 4, 150), (25, 2, 150)):
        base = [[rng.choice("abcdefghijkl"[:kinds]) for _ in range(n)] for _ in range(6)]
        lines = []
        for _ in range(count):
            t = list(rng.choice(base))
            for _ in range(rng.randint(0, n // 2)):
                t[rng.randrange(n)] = rng.choice(["<*>", *"abcdefghijkl"[:kinds]])
            lines.append(["x", "y", "z", *t[3:]])
        tree = templates.Leaf(0.7, 3)
        which, made = brute_templates(lines)
        assert [tree.place(t) for t in lines] == which and tree.templates == made


def test_leaf_of_unlike_lines_is_fast():
    rng = random.Random(22)
    lines = [["x", "y", "z", *prose(rng, 17).split()] for _ in range(4000)]
    tree, began = templates.Leaf(0.7, 3), time.perf_counter()
    for t in lines:
        tree.place(t)
    assert time.perf_counter() - began < 2 and len(tree.templates) > 3900


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(36)
    pool = [prose(rng, n) for n in (1, 2, 3, 4, 6, 9, 12, 21, 26, 30) for _ in range(3)]
    texts = []
    for _ in range(70):
        lines = [prose(rng, rng.randint(1, 30)) for _ in range(rng.randint(0, 6))]
        for x in rng.sample(pool, rng.randint(0, 5)):
            w = x.split()
            if len(w) > 4 and rng.random() < 0.5:
                w[rng.randrange(3, len(w))] = str(rng.randrange(1000))
            lines.insert(rng.randrange(len(lines) + 1), " ".join(w))
        texts.append("\n".join(lines))
    texts += [texts[3]] * 5 + ["", "\n\n", "a  b \r\nx", *[texts[5] + " more"] * 2, "line of a long text\n" * 3000 + "end"]
    got = dropped(spark, texts)
    # the copies are planted, all other texts are apart: a pair of equal words' pairs in a seventh meets by chance once in 200 times
    first = {t: k for k, t in reversed(list(enumerate(texts)))}
    groups = [5 if t == texts[5] + " more" else first[t] for t in texts]
    assert [got[k] for k in range(len(texts))] == brute_lines(texts, groups)
    assert any(got[k] != t for k, t in enumerate(texts))


def test_line_dedup_leaves_columns_of_the_same_names(spark):
    df = spark.createDataFrame([(1, "a\nb", 7, "x")], "doc_id long, text string, n_lines int, places string")
    assert templates.drop_templates(df, counts=None).collect() == df.collect()
    assert templates.drop_templates(df, counts=("lines", "gone")).columns == ["doc_id", "text", "n_lines", "places", "lines", "gone"]


def test_texts_of_one_hash_are_told_apart(spark):
    p = spark.createDataFrame([(1, 5, 1), (2, 5, 2), (3, 5, 2), (4, 6, 9)], "doc_id long, tkey long, other long")
    a, b = simhash.told_apart(p, p.withColumn("text", p.doc_id.cast("string")), Scratch(spark, "t"))
    keys = {r.doc_id: r.tkey for r in a.collect()}
    assert keys[1] == 5 and keys[4] == 6 and keys[2] == keys[3] not in (5, 6) and {r.doc_id: r.tkey for r in b.collect()} == keys


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(1)
    items = [prose(rng, 30) for _ in range(3)]
    rows = []
    for k in range(240):
        bad = ["stupid", "idiot", "worthless"] if k % 4 == 1 else []
        rows.append((k, f"{prose(rng, 70, bad)}\nThis notice {k} closes every text here", "en", "s", 0))
    rows[0] = (0, f"{prose(rng, 20)} {items[0]} {rows[0][1]}", "en", "s", 0)
    rows += [(300, rows[2][1], "en", "s", 0), (301, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k % 4 == 1), 1) for k in range(240)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / "out" / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / "out" / name))
        if name != "packing":
            assert tuple(docs.columns) == corpus_pipeline.DOCUMENTS
    left = {r.doc_id for r in seen["toxicity"].collect()}
    assert sum(k in left for k in range(240) if k % 4 == 1) <= 6 and sum(k in left for k in range(240) if k % 4 != 1) >= 174
    assert seen["line_dedup"].where("text LIKE '%notice%'").count() == 0
    assert not {300} & {r.doc_id for r in seen["near_dedup"].collect()}
    assert 0 not in {r.doc_id for r in seen["decontamination"].collect()}
    assert {r.doc_id for r in seen["packing"].collect()} == {r.doc_id for r in seen["decontamination"].collect()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["packing"].count()


def test_registered_names():
    from turnmill.llm import queries

    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 14))
    assert pa.__version__
