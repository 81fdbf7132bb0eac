"""The stored index of grams, and the formulas that regular expressions become."""

import random
import re

from pyspark.sql import functions as F

from turnmill.functions import gramplan
from turnmill.operators.grams import GramIndex, fold, search_pattern, search_phrase


def _pattern(rng, depth=0):
    def piece():
        k = rng.randrange(11)
        if k < 5:
            return "".join(rng.choice("abcsK") for _ in range(rng.randint(1, 5)))
        if k == 5:
            return rng.choice(["[ab]", "[a-c]", "[^a]", "[abcdefghijk]", "[\\\\d_]", "[s-t]"])
        if k == 6:
            return rng.choice([".", "\\w", "\\d", "\\s", "\\b", "\\x61", "\\u0062", "\\."])
        if k == 7:
            return rng.choice("abc") + rng.choice(["?", "*", "+", "{2}", "{1,3}", "{0,2}", "+?", "{2,}"])
        if k == 8 or depth > 1:
            return rng.choice(["^", "$", "ß", "ſ", "(?=a)", "(?!b)"])
        return f"({rng.choice(['', '?:'])}{_pattern(rng, depth + 1)}){rng.choice(['', '?', '{2}', '*', '+', '{1,2}'])}"

    return "|".join("".join(piece() for _ in range(rng.randint(1, 4))) for _ in range(rng.choice([1, 1, 2, 3])))


def test_formulas_hold_wherever_patterns_match():
    """2,000 random patterns over 200 random texts: no match without its grams."""
    rng = random.Random(1)
    texts = ["".join(rng.choice("aaabbbcccsskSABC _.1ßſ") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    done = asked = matches = 0
    while done < 2000:
        p = _pattern(rng)
        try:
            compiled = re.compile(p, re.IGNORECASE)
        except re.error:
            continue
        done += 1
        f = gramplan.formula(p)
        asked += f != gramplan.TRUE
        for t in texts:
            if compiled.search(t):
                matches += 1
                assert gramplan.holds(f, t), (p, t, f)
    assert asked > 800 and matches > 50_000


def test_formulas_of_patterns():
    assert gramplan.formula("th(is|at) of") == gramplan.Any((gramplan.All(("THI", "S O", " OF")), gramplan.All(("THA", "T O", " OF"))))
    assert gramplan.formula("abc.*def") == gramplan.All(("ABC", "DEF")) and gramplan.formula("a.b") == gramplan.TRUE
    assert gramplan.formula("(foo|ba)*") == gramplan.TRUE and gramplan.formula("abcd|..") == gramplan.TRUE and gramplan.formula("(?i)abc") == gramplan.TRUE


def test_texts_fold_alike_on_both_sides(spark):
    texts = ["ΟΔΟΣ ς σ", "İstanbul ı", "Straße ẞ ſ", "\u212a K k", "ǅ Ǆ", "日本語 Ａｂ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.f for r in df.select(fold(F.col("t")).alias("f")).collect()] == [gramplan.fold(t) for t in texts]


def _docs(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, content string")


def test_changes_keep_answers_right(spark, tmp_path):
    rng = random.Random(4)
    words = ["alpha", "beta", "Gamma", "delta", "the", "of", "Straße", None]
    make = lambda k: (k, rng.choice(words), None if rng.random() < 0.1 else " ".join(rng.choice(words[:-1]) for _ in range(rng.randint(0, 12))))
    rows = {k: make(k) for k in range(120)}
    index = GramIndex(spark, f"file://{tmp_path}/index", 8)
    index.put(_docs(spark, list(rows.values())))

    def check(index):
        now = _docs(spark, list(rows.values()))
        for phrase in ("alpha beta", "the of", "GAMMA", "of", "zzz"):
            want = sorted(k for k, t, c in rows.values() if any(phrase.lower() in (x or "").lower() for x in (t, c)))
            assert sorted(r.id for r in search_phrase(now, index, phrase).collect()) == want
        for p in ("(alpha|beta) g[a-e]m+a", "de.ta the", "o. the$", "(a+)+"):
            want = [] if p == "(a+)+" else sorted(k for k, _, c in rows.values() if re.search(p, c or "", re.I))
            assert sorted(r.id for r in search_pattern(now, index, p).collect()) == want

    check(index)
    changed = [make(k) for k in range(0, 120, 3)] + [make(k) for k in range(120, 140)]
    rows |= {r[0]: r for r in changed}
    n = index.put(_docs(spark, changed))
    check(index)
    index.put(_docs(spark, changed), n)  # a repeated batch
    check(index)
    for k in range(0, 140, 7):
        rows.pop(k)
    index.delete(spark.range(0, 140, 7))
    check(index)
    # a batch that failed before its end doesn't count
    spark.createDataFrame([("ALP", 10_000, 0)], "gram string, id long, part int").write.partitionBy("part").parquet(f"file://{tmp_path}/index/postings/batch=9")
    assert index.batches() == [0, 1, 2] and 10_000 not in {r.id for r in index.candidates("ALP").collect()}
    check(index.compact(f"file://{tmp_path}/compact"))


def test_a_search_reads_only_its_grams_folders(spark, tmp_path):
    index = GramIndex(spark, f"file://{tmp_path}/index", 32)
    index.put(_docs(spark, [(k, f"title {k}", f"some words of text {k * 977}") for k in range(300)]))
    found = index.candidates(gramplan.phrase("words of"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "part#" in plan and "In(gram" in plan.replace(" ", "") or "EqualTo(gram" in plan
    read = {f.split("part=")[1].split("/")[0] for f in index.postings(gramplan.grams(gramplan.phrase("words of"))).inputFiles() if "part=" in f}
    asked = {r.p for r in spark.createDataFrame([(g,) for g in gramplan.grams(gramplan.phrase("words of"))], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(32)).alias("p")).collect()}
    files = index.postings(gramplan.grams(gramplan.phrase("words of"))).select("gram").distinct().count()
    assert files == len(gramplan.grams(gramplan.phrase("words of"))) and len(asked) < 8 and read


def test_grams_are_taken_by_place_in_one_walk(spark):
    from turnmill.operators.grams import grams_of

    texts = ["ab😀c", "aaaa", "xy", "", None, "tion the " * 3000]
    made = grams_of(spark.createDataFrame([(k, None, t) for k, t in enumerate(texts)], "id long, title string, content string"))
    assert "substr" not in made._jdf.queryExecution().optimizedPlan().toString().lower()
    want = {(t[i : i + 3].upper(), k) for k, t in enumerate(texts) if t for i in range(len(t) - 2)}
    assert {(r.gram, r.id) for r in made.collect() if "\n" not in r.gram} == want  # line feeds lie between columns
