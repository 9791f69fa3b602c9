"""Splitting text into the matches of a tokenizer's pattern, and a bounded memo over them.

Byte-level BPE encodes each match by itself, so equal matches have equal ids, and a memo saves most
of the work. A text of characters below U+0180 only needs no Unicode tables: there the common
pattern is rewritten to explicit classes for the quicker ``re`` module, with the same matches.
"""

from __future__ import annotations

import itertools
import re
import unicodedata

import regex

#: The pattern that has a rewritten form (fixed value, as tokenizers of this family state it).
COMMON = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts with more characters are split piece by piece; matches with more are not remembered.
LONG_TEXT, LONG_MATCH = 1 << 22, 64


def _class(kind: str, end: int) -> str:
    return "".join(f"\\u{c:04x}" for c in range(end) if unicodedata.category(chr(c))[0] == kind)


def _rewritten(end: int) -> re.Pattern:
    letter, number, space = _class("L", end), _class("N", end), r"\t-\r\x20\x85\xa0"
    endings = "'s|'t|'re|'ve|'m|'ll|'d"
    return re.compile(rf"{endings}| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class Splitter:
    """All matches of a pattern in a text, in order, as lists of strings."""

    def __init__(self, pattern: str):
        self.general = regex.compile(pattern)
        self.ascii, self.latin = (_rewritten(0x80), _rewritten(0x180)) if pattern == COMMON else (self.general, self.general)
        self.beyond = re.compile("[^\0-ſ]")

    def __call__(self, text: str | None):
        """Yield lists that together are the matches; a text of usual length gives one list."""
        if not text:
            return
        pattern = self.ascii if text.isascii() else self.general if self.beyond.search(text) else self.latin
        if len(text) <= LONG_TEXT:
            yield pattern.findall(text)
            return
        found = pattern.finditer(text)
        while part := [m[0] for m in itertools.islice(found, LONG_TEXT // 4)]:
            yield part


class Memo:
    """Ids of matches, by ``encode``, remembered up to ``limit`` matches; then it starts anew.

    It is a plain dictionary of strings and bytes, which the garbage collector does not go through.
    """

    def __init__(self, encode, limit: int = 700_000):
        self.encode, self.limit = encode, limit
        self.known: dict[str, bytes] = {}

    def ids(self, matches: list[str]) -> bytes:
        """The ids of all matches, one after another."""
        if len(self.known) > self.limit:
            self.known = {}
        known = self.known
        out = list(map(known.get, matches))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    match = matches[i]
                    ids = out[i] = known.get(match) or self.encode(match)
                    if len(match) <= LONG_MATCH:
                        known[match] = ids
        return b"".join(out)
