"""Vocabulary files of byte-level BPE tokenizers, and the pieces of a text that merges never cross."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

#: White space as the tokenizer libraries' patterns see it (fixed values: Unicode's White_Space property).
SPACE_CLASS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters beyond ASCII that are one character in any normal form and lower-case one by one.
WESTERN = "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
#: Texts of ASCII and those letters only are split by this module's patterns, others by the library's own tables.
SIMPLE = re.compile("[\\x00-\\x7fÀ-ÖØ-öø-ÿ]*")
#: Bytes of remembered pieces that a task may hold (estimated), and the longest piece that is worth remembering.
CACHE_BYTES, CACHED_CHARS = 56_000_000, 40
#: Estimated bytes of an entry besides its key's characters and its value's bytes.
ENTRY = 160


@lru_cache(maxsize=1)
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Merges:
    """Ranks of adjacent symbols. ``pairs`` maps ``left << 20 | right`` to ``rank << 20 | merged symbol``."""

    def __init__(self, path: str, normalizer: dict | None, pre_tokenizer: dict):
        """The vocabulary at ``path``; ValueError unless its texts are normalized and cut as the caller does it."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if spec.get("normalizer") != normalizer or spec.get("pre_tokenizer") != pre_tokenizer:
            raise ValueError(f"{path} normalizes or cuts texts in another way than this operator")
        if any(t[flag] for t in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has special strings that aren't taken as they stand")
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        vocab: dict[str, int] = model["vocab"]
        self.names = {i: s for s, i in vocab.items()}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: s for s, i in self.specials.items()}
        prefix = len(model.get("continuing_subword_prefix") or "")
        self.pairs: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[vocab[a] << 20 | vocab[b]] = rank << 20 | vocab[a + b[prefix:]]
        self.first = {s: vocab[s] for s in byte_symbols()}
        self.last = {s: vocab[s + self.suffix] for s in byte_symbols()}
        for b, s in enumerate(byte_symbols()[:128]):  # ASCII may also be spelt as it is
            self.first[chr(b)], self.last[chr(b)] = self.first[s], self.last[s]
        self.spelling = {ord(c): "".join(byte_symbols()[b] for b in c.encode()) for c in WESTERN}
        self.marks = {s[0] for s in self.specials}
        found = [re.escape(s) for s in sorted(self.specials, key=len, reverse=True)]
        self.special_pattern = re.compile("(" + "|".join(found) + ")") if found else None

    def symbols(self, piece: str) -> list[int]:
        """The initial symbols of a piece of ASCII, or one spelt in byte symbols."""
        first = self.first
        out = [first[c] for c in piece]
        out[-1] = self.last[piece[-1]]
        return out

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """(segment, is it a special string) in order; empty segments are left out."""
        if not any(mark in text for mark in self.marks):
            if text:
                yield text, False
            return
        for k, part in enumerate(self.special_pattern.split(text)):
            if part:
                yield part, bool(k % 2)


class Remembered(dict):
    """What ``make`` gives for a key; short keys are remembered within a number of bytes.

    Half of it is for keys seen lately, half for those before them: when the first half is full it takes the place of the
    other, so that what is looked up again and again stays.
    """

    def __init__(self, make: Callable, most: int = CACHE_BYTES):
        super().__init__()
        self.make, self.most, self.size = make, most, 0
        self.before: dict = {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHED_CHARS:
            size = ENTRY + len(key) + (len(value) if isinstance(value, bytes) else 0)
            if self.size + size > self.most // 2:
                self.before = dict(self)
                self.clear()
                self.size = 0
            self.size += size
            self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.before, self.size = {}, 0


@lru_cache(maxsize=4)
def library(path: str):
    """The public library's tokenizer, whose Unicode tables split whatever is not ASCII."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
