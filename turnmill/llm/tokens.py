"""Exact token ids at speed: each distinct unit of text between white space is encoded once, then ids are gathered.

A unit ends only where a non-space character meets a space or line feed. Both public vocabularies split there whatever
the context, so encoding units alone gives the ids of the whole text. Units of plain Latin letters, with one mark after
them at most, go to the vocabulary's merge model directly; all others through the whole tokenizer."""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import flat_ranges, split_words

LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: RE2 classes of white space in the sense of Unicode.
BLANK = r"\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Units that a worker remembers; about 200 bytes each.
REMEMBERED = 300_000

_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker, so that later tasks find its memory filled."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def byte_letters() -> list[str]:
    """The letter for each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a special token's string inside a text is ordinary text
        spec = json.loads(self.tokenizer.to_str())
        self.keeps_space = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        self.vocab: dict[str, int] = self.tokenizer.get_vocab()
        self.wide = "H" if max(self.vocab.values()) < 1 << 16 else "I"
        self.dtype = np.dtype(np.uint16 if self.wide == "H" else np.uint32)
        self.letters = byte_letters()
        self.memory: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}

    def marks(self, needed: str) -> np.ndarray:
        """Ids of tokens that consist of closing marks only and hold one of those needed."""
        closing = set(needed) | set("\"')]»”’")
        return np.array(sorted(i for t, i in self.vocab.items() if (s := t.removesuffix("</w>")) and set(s) <= closing and set(s) & set(needed)), np.int64)

    def _word(self, letters: str) -> bytes:
        """Ids of letters with at most a space before them, through the merge model alone."""
        ids = self.memory.get(letters)
        if ids is None:
            if letters.isascii():
                known = letters.replace(" ", self.letters[32]).replace("\n", self.letters[10])
            else:
                known = "".join([self.letters[b] for b in letters.encode()])
            ids = array(self.wide, [t.id for t in self.tokenizer.model.tokenize(known)]).tobytes()
            if len(self.memory) < REMEMBERED and len(letters) < 64:
                self.memory[letters] = ids
        return ids

    def _plain(self, unit: str) -> bytes | None:
        mark = unit[-1] if unit[-1:] in (".", ",") else ""
        word = unit[:-1] if mark else unit
        first = word[:1]
        body = word[1:] if first in (" ", "\n") else word
        if not (body.isascii() and body.isalpha() or LATIN.fullmatch(body)):
            return None
        if not self.keeps_space:
            ids = self._word(body.lower())
        elif first == "\n":
            ids = self._word("\n") + self._word(body)
        else:
            ids = self._word(word)
        return ids + self._word(mark) if mark else ids

    def units_ids(self, units: list[str]) -> list[bytes]:
        memory, out, odd = self.odd, [], []
        for k, unit in enumerate(units):
            ids = self._plain(unit)
            if ids is None:
                ids = memory.get(unit)
                if ids is None:
                    odd.append(k)
            out.append(ids)
        for at in range(0, len(odd), 4096):
            part = odd[at : at + 4096]
            for k, e in zip(part, self.tokenizer.encode_batch_fast([units[k] for k in part], add_special_tokens=False), strict=True):
                out[k] = ids = array(self.wide, e.ids).tobytes()
                if len(memory) < REMEMBERED // 4 and len(units[k]) < 64:
                    memory[units[k]] = ids
        return out

    def _split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        if not self.keeps_space:
            return split_words(texts)
        # NUL marks the cuts, so a text that holds one is a single unit
        marked = pc.replace_substring_regex(texts, pattern=f"([^{BLANK}])([ \\n])", replacement="\\1\x00\\2")
        if pc.any(pc.match_substring(texts, "\x00")).as_py():
            holds = pc.match_substring(texts, "\x00").to_numpy(zero_copy_only=False)
            lists = [[t] if h else m.split("\x00") for t, m, h in zip(texts.to_pylist(), marked.to_pylist(), holds, strict=True)]
            return pa.array([u for x in lists for u in x], pa.large_string()), np.cumsum([0, *map(len, lists)])
        parts = pc.split_pattern(marked, pattern="\x00")
        return parts.flatten(), parts.offsets.to_numpy().astype(np.int64)

    def _single_spaced(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray] | None:
        """Distinct units, the unit of each place, and where each text's begin, if single spaces and line feeds are all the
        white space of all texts; the words are then told apart without the mark before them."""
        if texts.offset or len(texts) and texts.buffers()[1] is None or len(texts) and np.frombuffer(texts.buffers()[1], np.int64)[0]:
            return None  # cut from a larger array
        values, at = split_words(texts)
        size = pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(size + 1)])
        length = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        if (np.maximum(sums[at[1:]] - sums[at[:-1]] - 1, 0) != length).any() or pc.any(pc.match_substring_regex(values, f"[{BLANK}]")).as_py():
            return None
        raw = np.frombuffer(texts.buffers()[2], np.uint8) if len(values) else np.zeros(0, np.uint8)
        # texts lie one after another; a word's mark is the byte before it, and each text's first word has none
        first = np.zeros(len(values), bool)
        first[at[:-1][np.diff(at) > 0]] = True
        start = np.concatenate([[0], np.cumsum(length)])[:-1]
        begin = sums[:-1] - np.repeat(sums[at[:-1]] - start, np.diff(at))
        mark = np.where(first, 0, np.where(raw[np.maximum(begin - 1, 0)] == 32, 1, 2))
        if ((mark == 2) & (raw[np.maximum(begin - 1, 0)] != 10)).any():
            return None
        coded = values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 3 + mark
        used = np.bincount(code, minlength=3 * len(words)) > 0
        units = [("", " ", "\n")[c % 3] + words[c // 3] for c in np.flatnonzero(used).tolist()]
        return units, (np.cumsum(used) - 1)[code], at

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by `end` if given, and where each text's ids begin."""
        single = self._single_spaced(texts) if self.keeps_space else None
        if single is None:
            units, offsets = self._split(texts)
            coded = units.dictionary_encode()
            single = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), offsets
        units, which, offsets = single
        known = self.units_ids(units)
        pool = np.frombuffer(b"".join(known), self.dtype)
        size = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        begin = np.cumsum(size) - size
        lengths = size[which]
        ids = pool[flat_ranges(begin[which], lengths)]
        at = np.concatenate([[0], np.cumsum(lengths)])[offsets]
        if end is None:
            return ids, at
        n = len(at) - 1
        out = np.empty(len(ids) + n, self.dtype)
        ends = at[1:] + np.arange(n)
        hole = np.ones(len(out), bool)
        hole[ends] = False
        out[hole], out[ends] = ids, end
        return out, at + np.arange(n + 1)
