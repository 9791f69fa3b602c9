"""Words, shapes and sentences of many texts at once, as arrays.

Texts are joined into one byte array; a word is a run of bytes of a class. Its hash is a
polynomial over its bytes: with prefix sums of byte * B^place, modulo 2^64, the hash of bytes
s..e is (sum[e] - sum[s]) * B^-s, so all words, prefixes and suffixes cost a few array operations.
Documents are handled in groups of about ``GROUP`` bytes, which bounds memory; one longer text
is a group of its own.
"""

from __future__ import annotations

import numpy as np

GROUP = 1 << 18
_B = 0x9E3779B97F4A7C15
_INVERSE = pow(_B, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i for i up to n."""
    while len(_powers[0]) <= n:
        size = len(_powers[0])
        for k, base in enumerate((_B, _INVERSE)):
            step = np.uint64(pow(base, size, 1 << 64))
            _powers[k] = np.concatenate([_powers[k], _powers[k] * step])
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of polynomial hashes, of which the low ones are weak."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def groups(texts: list[str | None], limit: int = GROUP):
    """Yield (first, end) of runs of texts of about ``limit`` characters."""
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def _table(*classes: tuple[str, int]) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for chars, code in classes:
        t[np.frombuffer(chars.encode("latin-1"), np.uint8)] = code
    return t


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_DIGITS, _UPPER, _SMALL = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HIGH = bytes(range(128, 256)).decode("latin-1")
_LETTERS = _table((_DIGITS + _UPPER + _SMALL + _HIGH, 1))
_NOT_SPACE = np.ones(256, np.uint8)
_NOT_SPACE[[32, *range(9, 14)]] = 0
#: Kinds of bytes in a shape: letters and digits count as their kind, other bytes as themselves.
_KINDS = np.arange(256, dtype=np.uint8)
for _chars, _code in ((_DIGITS, 48), (_UPPER, 65), (_SMALL, 97), (_HIGH, 97)):
    _KINDS[np.frombuffer(_chars.encode("latin-1"), np.uint8)] = _code


class Words:
    """The words of some texts: start, end (places in ``data``), doc (number of the text)."""

    def __init__(self, texts: list[str | None], *, spaced: bool):
        """``spaced``: words are runs without white space; else runs of letters, digits and bytes from 128."""
        parts = [(t or "").encode("utf-8", "replace") for t in texts]
        self.raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        self.data = _LOWER[self.raw]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        self.begin = np.concatenate([[0], np.cumsum(lengths)])  # of each text
        inside = (_NOT_SPACE if spaced else _LETTERS)[self.raw].astype(bool)
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.start, self.end = edge[::2], edge[1::2]
        self.doc = np.searchsorted(self.begin, self.start, "right") - 1
        n = len(self.data)
        self._up, self._down = _power_tables(n)
        self._sum = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * self._up[:n], out=self._sum[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of the lower-cased bytes from start to end."""
        return mixed((self._sum[end] - self._sum[start]) * self._down[start])

    def shapes(self) -> np.ndarray:
        """Mixed hashes of the words' kinds of bytes, equal neighbours counting once."""
        kinds = _KINDS[self.raw]
        fresh = np.ones(len(kinds), bool)
        fresh[1:] = kinds[1:] != kinds[:-1]
        fresh[self.start] = True
        turn = np.cumsum(fresh) - 1
        total = np.zeros(len(kinds) + 1, np.uint64)
        np.cumsum(np.where(fresh, (kinds.astype(np.uint64) + np.uint64(1)) * self._up[turn], np.uint64(0)), out=total[1:])
        return mixed((total[self.end] - total[self.start]) * self._down[turn[self.start]])


def per_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by ``doc``, which ascends; documents without rows get zeros."""
    out = np.zeros((n, *values.shape[1:]), np.float64)
    if len(doc):
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        out[doc[first]] = np.add.reduceat(values, first, axis=0)
    return out
