from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnmill.functions import diagraph, grammar, phrases, regexplan, windows
from turnmill.functions import text as X
from turnmill.functions.guard import Guard, Limits, policy_of

HAN = st.text("我你不去学校因为没时间的了是 ，。？ab", max_size=14)


def brute_longest(a, b, most=5):
    a, b = phrases.normalized(a), phrases.normalized(b)
    found, best = [], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            n = 0
            while n < min(i, j) and a[i - 1 - n] == b[j - 1 - n] and not a[i - 1 - n].isspace():
                n += 1
            if n < 2:
                continue
            p = phrases.trimmed(a[i - n : i])
            if phrases.substantive(p):
                if len(p) > best:
                    best, found = len(p), []
                if len(p) == best:
                    found.append(p)
    return list(dict.fromkeys(found))[:most]


@given(HAN, HAN)
def test_longest_common_phrases_match_every_pair_of_ends(a, b):
    # every length of a run is a candidate in the cell by cell form; only its longest one is taken here
    assert phrases.longest_common(a, b) == brute_longest(a, b)


def test_features():
    f = phrases.features("你为什么不去学校？", "我不是不去学校，是没时间，因为下雨")
    assert f["shared_terms"] == ["去学校"] and all(f[k] for k in ("has_lexical_echo", "has_pattern_reuse", "has_question_response", "has_negation_turn", "has_repair_repetition"))
    assert not any(v for k, v in phrases.features(None, "").items() if k.startswith("has_"))


def test_merged_terms_evict_what_they_contain():
    assert phrases.merged(["学校", "去学校", "学"]) == ["去学校"]


def test_regex_plan():
    assert regexplan.alternatives("th(is|at) of") == ["this of", "that of"]
    assert regexplan.prefilters("ab.*cde") == ["cde", "ab"]
    assert [regexplan.error(p) for p in ("(a+)+", "x*", "(", "a" * 81, "ab")] == ["too_slow", "matches_empty", "invalid", "too_long", ""]


def test_escapes_of_control_characters_and_numbers_are_no_letters():
    assert [regexplan.alternatives(p) for p in (r"x\tb", r"ab\x41cd", r"a\nb", r"a\.b")] == [[], [], [], ["a.b"]]
    assert regexplan.prefilters(r"ab\x41cd\tef") == ["ab", "cd", "ef"][:2] and regexplan.java(r"a\Z{(?P<n>x)[[&]") == r"a\z\{(?<n>x)[\[\&]"


@settings(max_examples=2000)
@given(st.text("abftnxuN(|)?*.\\[]{}14", max_size=8))
@example(r"\a")
@example(r"x\tb")
@example(r"ab\x41cd")
def test_alternatives_stand_for_the_pattern(p):
    import re

    found = regexplan.alternatives(p)
    if found and not regexplan.error(p):
        assert all(re.fullmatch(regexplan.normalize(p), x) for x in found)


def test_turn_grammar():
    assert grammar.split_content("【甲】：你好啊\n【乙】：再见吧") == [("甲", "你好啊"), ("乙", "再见吧")]
    assert grammar.split_content("记者：您好。主任：欢迎各位") == [("记者", "您好。"), ("主任", "欢迎各位")]
    assert grammar.split_content("其中：一句话") == [("", "其中：一句话")] and grammar.split_content(None) == []
    assert grammar.merge_turns("开头\n【甲】：一\n接着\n乙：二") == [("甲", "一\n接着"), ("乙", "二")]
    assert grammar.interview_turns("来源：网\n记者：问题一\n专家：回答一") == ["记者：问题一", "专家：回答一"]


def test_diagraph_punctuation_never_makes_a_column():
    g = diagraph.Grid(["“好”，真的？", "好！当然。"], phrases.merged(["好", "？"], ["！", "。"]))
    assert not any(set(c) & set("？！。，“”") for row in g.cells for c in row.values())


def test_diagraph_negation_response():
    g = diagraph.Grid(["你为什么不去？", "我不是不去，是没时间。"], phrases.merged(["不去"], ["为什么", "不是"]))
    kinds = {r["relation"] for r in g.relations()}
    assert {"否定回应", "疑问回应"} <= kinds
    states = {x["key"]: x["support_state"] for x in diagraph.support(g.relations(), {"contrast", "analogy_candidate"})}
    assert states["contrast"] == "joint" and states["analogy_candidate"] == "bert_review" and states["parallelism"] == "none"
    assert [diagraph.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_guard():
    g = Guard(Limits({n: (3, 60, 120) for n in ("general", "search", "resonance", "context", "export", "audio", "login")}, last_page=10, honeypot=600))
    ask = lambda t, **k: g.decide(t, k.pop("path", "/search"), ip="1.1.1.1", visitor="v", agent="Mozilla", **k)
    assert [ask(t).allowed for t in (0, 1, 2)] == [True] * 3
    d = ask(3)
    assert (d.reason, d.status, d.retry_after) == ("rate_limit", 429, 120)
    assert ask(100).reason == "temporary_block" and ask(124).allowed
    assert ask(130, page=11).reason == "deep_pagination"
    assert ask(131, path="/corpus-export-all").reason == "honeypot" and ask(700).reason == "temporary_block"
    assert Guard().decide(0, "/api/resonance", ip="2", agent="Mozilla").reason == "missing_fetch_signal"
    assert Guard().decide(0, "/resonance/data", ip="2", agent="curl/8", requested_with="fetch").reason == "automation_client"
    assert Guard().decide(0, "/search", ip="2", fetch_site="cross-site", agent="x").reason == "cross_site"
    assert [policy_of(p) for p in ("/search", "/audio/1", "/api/diagraph/export_csv", "/api/diagraph/1", "/")] == ["search", "audio", "export", "context", "general"]


def test_window_merging():
    w = lambda *t: [(s, x) for s, x in t]
    a, b, c, d = ("甲", "一"), ("乙", "二"), ("甲", "三"), ("乙", "四")
    kept, equal, inside = windows.merge([("s", "", "t1", "chunk1", w(a, b, c)), ("s", "", "t2", "chunk1", w(b, c)), ("s", "", "t3", "chunk2", w(c, d)), ("s", "", "t4", "chunk3", w(("丙", "x"), ("丁", "y")))])
    assert [len(k.turns) for k in kept] == [4, 2] and (kept[0].merges, kept[0].contained) == (1, 1) and not equal and not inside
    assert windows.utterances("记者：请问一下这个问题怎么看待\n专家：我们认为这个问题很重要")[1][0] == "专家"
    assert windows.page("<title>标题甲_站</title><p>2019年</p><script>x</script>")["title"] == "标题甲"


def test_text_columns_agree_with_python(spark):
    rows = [("  你 好　吗 ", "记者：你好啊"), ("", "其中：不是"), (None, None), ("a\r\nb", "【甲】： 再见")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(X.normalize_turn(F.col("a")), X.content_hash(F.col("a")), X.parse_speaker(F.col("b")), X.resonance_tokens(F.col("b")), X.frames_in_both(F.col("a"), F.col("b"))).collect()
    import hashlib

    for (a, b), r in zip(rows, got):
        assert r[0] == phrases.normalized(a)
        assert r[1] == hashlib.sha256((a or "").strip().replace("\r\n", "\n").replace("\r", "\n").encode()).hexdigest()
        assert tuple(r[2]) == grammar.speaker_and_text(b or "")
        assert r[3] == phrases.tokens(b)


def test_resonance_tokens_column_equals_python(spark):
    texts = ["我们现在去学校吧，学校很远", "the school and the 学校 ab12 _x", "", "好", "为什么不去公园公园"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.resonance_tokens(F.col("t"))).collect()
    assert [r[0] for r in got] == [phrases.tokens(t) for t in texts]


def test_relation_model_learns_and_generalises():
    import random

    from turnmill.functions import relation_model

    rng = random.Random(3)
    chars = "春夏秋冬山水花鸟天地人和上下左右大小多少"
    said = lambda n: "".join(rng.choice(chars) for _ in range(n))
    rows = []
    for k in range(600):
        a, b, shown = said(8), said(8), set()
        if k % 3 == 0:
            b, shown = f"不是{b}", shown | {"contrast"}
        if k % 4 == 0:
            b, shown = b + a[2:6], shown | {"reproduction"}
        rows.append((a, b, shown))
    keys = ("reproduction", "contrast", "repair")
    model = relation_model.train(*map(list, zip(*rows[:400])), keys)
    p = model([r[0] for r in rows[400:]], [r[1] for r in rows[400:]])
    for key in keys[:2]:
        yes, no = ([x[key] for x, r in zip(p, rows[400:]) if (key in r[2]) == want] for want in (True, False))
        assert sum(x > y for x in yes for y in no) > 0.93 * len(yes) * len(no)
    assert all(x["repair"] < 0.01 for x in p) and relation_model.train([], [], [], keys)(["a"], [None])[0].keys() == set(keys)
