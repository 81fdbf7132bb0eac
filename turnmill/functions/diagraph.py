"""Alignment of a few turns into a grid of columns, and the relations that the columns show."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

from . import phrases as P

# ---- fixed values ------------------------------------------------------------------------------------------------------
WINDOWS = ("pair", "context2", "context5", "full")
PERSONS = {"我": "dialogue_person_singular", "你": "dialogue_person_singular", "我们": "dialogue_person_plural", "你们": "dialogue_person_plural", "他": "third_person_singular", "她": "third_person_singular", "它": "third_person_singular", "他们": "third_person_plural", "她们": "third_person_plural", "它们": "third_person_plural"}
NEGATIONS = tuple("用不着 没有 不是 不能 不要 别 没 不".split())
QUESTIONS = tuple("为什么 怎么 多少 什么 谁 哪儿 哪里 吗 呢 吧 ？ ?".split())
REPAIRS = tuple("也就是说 我是说 其实 不过 但是 可是 反而 不是…而是".split())
FRAMES = tuple("我觉得 能不能 可不可以 为什么 因为 不是 而是 也就是说 我是说".split())
CHUNKS = ("其他", "其它")
SPLIT_NEGATIONS = {"不知道": ("不", "知道"), "不觉得": ("不", "觉得"), "不明白": ("不", "明白"), "不理解": ("不", "理解")}
MECHANISMS = ("reproduction", "parallelism", "selective_reuse", "repair", "contrast", "analogy_candidate")
THRESHOLDS = dict(zip(MECHANISMS, (0.58, 0.42, 0.72, 0.24, 0.26, 0.90), strict=True))
#: Relation and mechanisms by kind of column.
RELATIONS = {"question": ("疑问词", ["selective_reuse"]), "negation": ("否定", ["contrast"]), "repair": ("转折/修正", ["repair", "contrast"]), "frame": ("句式复现", ["parallelism"]), "lexical": ("词汇重现", ["reproduction"])}

MARK = set("，。！？、；：,.!?;:…")


def _mark(c: str) -> bool:
    return c in MARK or unicodedata.category(c).startswith("P")


class Token:
    __slots__ = ("text", "kind", "group")

    def __init__(self, text: str):
        self.text, self.group = text, text
        if text in PERSONS:
            self.kind, self.group = "pronoun", PERSONS[text]
        else:
            kinds = (("negation", NEGATIONS), ("question", QUESTIONS), ("repair", REPAIRS))
            self.kind = next((k for k, terms in kinds if text in terms), "frame" if text in FRAMES else "lexical")
            if self.kind not in ("frame", "lexical"):
                self.group = self.kind

    def fits(self, other: Token) -> bool:
        if self.text == other.text:
            return True
        return self.kind == other.kind and (self.kind in ("negation", "question", "repair") or self.kind == "pronoun" and self.group == other.group)


def anchors(texts: list[str], terms: list[str]) -> list[str]:
    """The terms, what any two texts have in common, and frames. Two texts without a common pair of characters have nothing, equal pairs of
    texts the same; and texts are only compared until there are terms enough."""
    plain = [P.normalized(t) for t in texts]
    pairs = [{t[k : k + 2] for k in range(len(t) - 1)} for t in plain]
    known: dict[tuple[str, str], list[str]] = {}

    def common() -> Iterator[str]:
        for i, a in enumerate(plain):
            for j in range(i + 1, len(plain)):
                b = plain[j]
                if (a, b) not in known:
                    known[a, b] = [] if pairs[i].isdisjoint(pairs[j]) else P.longest_common(a, b, 3)
                yield from known[a, b]

    return P.merged(terms, common(), list(FRAMES))


def tokenize(text: str, lexicon: list[str]) -> list[Token]:
    """Longest known terms first, runs of Latin letters and digits, and what lies between; marks and space only separate."""
    known = {*lexicon, *PERSONS, *NEGATIONS, *QUESTIONS, *REPAIRS, *FRAMES, *CHUNKS}
    known = sorted((t for t in known if t and not any(map(_mark, t))), key=len, reverse=True)
    pattern = re.compile("|".join([*map(re.escape, known), "[A-Za-z0-9_]+"]))
    out, rest, i, text = [], "", 0, P.normalized(text)

    def flush() -> None:
        nonlocal rest
        if rest:
            out.append(Token(rest))
        rest = ""

    while i < len(text):
        m = pattern.match(text, i)
        if m:
            flush()
            term = m[0]
            if term in SPLIT_NEGATIONS:
                out += map(Token, SPLIT_NEGATIONS[term])
            elif term[0] in "不没" and len(term) >= 3 and P.substantive(term[1:]):
                out += [Token(term[0]), Token(term[1:])]
            else:
                out.append(Token(term))
            i = m.end()
            continue
        if text[i].isspace() or _mark(text[i]):
            flush()
        else:
            rest += text[i]
        i += 1
    flush()
    return out


def alignment(a: list[Token], b: list[Token]) -> list[tuple[int, int]]:
    """Of a longest common subsequence under fits(): the earliest places in b, then in a."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i].fits(b[j]) else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i].fits(b[j]):
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def column_name(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


class Grid:
    """columns: their first tokens; cells: for each row, column number to text."""

    def __init__(self, texts: list[str], terms: list[str]):
        lexicon = anchors(texts, terms)
        rows = [tokenize(t, lexicon) for t in texts]
        self.columns: list[Token] = []
        for row in rows:
            out, i, j = [], 0, 0
            for x, y in [*alignment(self.columns, row), (len(self.columns), len(row))]:
                out += self.columns[i:x] + row[j:y] + self.columns[x : x + 1]
                i, j = x + 1, y + 1
            self.columns = out
        self.cells = [{x: row[y].text for x, y in alignment(self.columns, row)} for row in rows]

    def named_cells(self) -> list[dict[str, str]]:
        return [{column_name(i): t for i, t in sorted(row.items())} for row in self.cells]

    def relations(self) -> list[dict]:
        out = []
        joined = lambda values: "：".join(dict.fromkeys(v for v in values if v))
        span = lambda a, b: column_name(a) if a == b else f"{column_name(a)}-{column_name(b)}"
        at = [[r for r, row in enumerate(self.cells) if i in row] for i in range(len(self.columns))]
        add = lambda column, mapping, relation, keys: out.append({"column": column, "mapping": mapping, "relation": relation, "mechanisms": keys})
        for i, token in enumerate(self.columns):
            values = [self.cells[r][i] for r in at[i]]
            if not values or token.kind in ("pronoun", "frame", "lexical") and len(values) < 2:
                continue
            if token.kind == "pronoun":
                relation, keys = "共指候选" if token.group.startswith("third") else "人称映射", ["selective_reuse"]
            else:
                relation, keys = RELATIONS[token.kind]
            add(column_name(i), joined(values), relation, list(keys))
        for i, token in enumerate(self.columns[:-1]):
            if token.kind == "negation":
                later = [self.cells[r] for r in at[i] if r]
                if both := joined(row[i] + row[i + 1] for row in later if i + 1 in row):
                    add(span(i, i + 1), both, "否定回应", ["contrast", "repair"])
        asked = [i for i, t in enumerate(self.columns) if t.kind == "question" and any(r < len(self.cells) - 1 for r in at[i])]
        if asked and len(self.cells) > 1:
            add(span(asked[0], asked[-1]), joined(row.get(i, "") for row in self.cells for i in asked), "疑问回应", ["selective_reuse"])
        return out


def support(relations: list[dict], suggested: set[str] = frozenset()) -> list[dict]:
    """For each mechanism how many relations show it, and whether rules, the scorer, both or none support it."""
    n = Counter(k for r in relations for k in r["mechanisms"])
    state = lambda k: ("joint" if k in suggested else "rule") if n[k] else "bert_review" if k in suggested else "none"
    return [{"key": k, "rule_support": n[k], "support_state": state(k)} for k in MECHANISMS]
