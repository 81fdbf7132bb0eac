"""Shared phrases of two texts and the resonance features built on them: plain Python for Arrow-batched UDFs."""

from __future__ import annotations

import re
from collections.abc import Iterable

from . import lexicon as L

SPACES = re.compile(r"\s+")
CHUNK = re.compile(L.CHUNK)
HAN = re.compile("[一-鿿]+")
FRAMES = [(label, re.compile(p)) for label, p in L.FRAMES]


def normalized(text: str | None) -> str:
    return SPACES.sub(" ", (text or "").strip())


def tokens(text: str | None, most: int = 24) -> list[str]:
    text = normalized(text)
    han = "".join(HAN.findall(text))
    chunks = (t for t in CHUNK.findall(text) if t not in L.STOPWORDS)
    bigrams = (p for p in map("".join, zip(han, han[1:])) if not L.STOP_CHARS.intersection(p) and p not in L.STOPWORDS)
    return list(dict.fromkeys([*chunks, *bigrams]))[:most]


def trimmed(phrase: str | None) -> str:
    """Without marks at the ends, then without stop characters there while more than two characters are left."""
    phrase = (phrase or "").strip().strip(L.PHRASE_EDGE)
    a, b = 0, len(phrase)
    while b - a > 2 and phrase[a] in L.STOP_CHARS:
        a += 1
    while b - a > 2 and phrase[b - 1] in L.STOP_CHARS:
        b -= 1
    return phrase[a:b]


def substantive(phrase: str) -> bool:
    phrase = trimmed(phrase)
    return len(phrase) >= 2 and phrase not in L.STOPWORDS and not L.STOP_CHARS.issuperset(phrase)


def longest_common(a: str | None, b: str | None, most: int = 5) -> list[str]:
    """The common substrings, free of white space, whose trimmed form is longest, in order of their end in a, then b."""
    a, b = normalized(a), normalized(b)
    at: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        if not c.isspace():
            at.setdefault(c, []).append(j)
    runs: dict[int, int] = {}  # by place in b: length of the common run that ends there
    best, found = 2, {}
    for i, c in enumerate(a):
        now = {j: runs.get(j - 1, 0) + 1 for j in at.get(c, ())}
        for n in now.values():
            if n < best:
                continue  # trimming only shortens
            phrase = trimmed(a[i + 1 - n : i + 1])
            if len(phrase) >= best and substantive(phrase):
                if len(phrase) > best:
                    best, found = len(phrase), {}
                found[phrase] = None
        runs = now
    return list(found)[:most]


def merged(*groups: Iterable[str], most: int = 24) -> list[str]:
    """Terms in order; one inside a kept one is skipped, kept ones inside a new one give way. No more are taken than are needed."""
    kept: list[str] = []
    for term in (trimmed(t) for g in groups for t in g):
        if not substantive(term) or any(term in k for k in kept):
            continue
        kept = [k for k in kept if k not in term] + [term]
        if len(kept) >= most:
            break
    return kept


def shared(a: str | None, b: str | None) -> list[str]:
    other = set(tokens(b))
    return merged(longest_common(a, b), [t for t in tokens(a) if t in other])


def frames(a: str, b: str) -> list[str]:
    found = [label for label, p in FRAMES if p.search(a) and p.search(b)]
    return found + ["为什么...因为"] * ("为什么" in a and "因为" in b)


def features(a: str | None, b: str | None) -> dict:
    """shared_terms, markers and the five flags of a pair of adjacent turns."""
    a, b = a or "", b or ""
    common, patterns = shared(a, b), frames(a, b)
    within = lambda terms, text: [t for t in terms if t in text]
    asked, contrast, revised = within(L.QUESTION_MARKERS, a), within(L.CONTRAST_MARKERS, b), within(L.REVISION_MARKERS, b)
    answered = bool(asked) and (bool(within(L.RESPONSE_MARKERS, b)) or len(b) >= 8)
    found = {
        "lexical_echo": common[:5],
        "pattern_reuse": patterns[:4] or (common[:4] if len(common) > 1 else []),
        "qa_response": asked[:3] if answered else [],
        "contrast_response": contrast[:4],
        "repair_revision": list(dict.fromkeys(common[:3] + revised[:3])) if common and revised else [],
    }
    markers = list(dict.fromkeys(t for name in L.FLAGS for t in found[name]))[:12]
    return {"shared_terms": common[:8], "markers": markers} | {flag: int(bool(found[name])) for name, flag in L.FLAGS.items()}
