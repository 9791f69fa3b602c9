"""Byte-level BPE: a minimal perfect hash over the vocabulary, and a heap for everything else.

A pre-token that is a vocabulary entry as a whole is that entry's id (byte-level BPE merges it
to that, see ``Vocabulary``). It is found by one hash, one displacement and one comparison: the
perfect hash maps the n entries to n slots without gaps, so the table holds entries only. Other
pre-tokens are merged: their bytes are a doubly linked list, the possible merges wait in a heap
by rank and place, and merges whose parts have changed meanwhile are skipped when they come up.
That is O(n log n) for a pre-token of n bytes, however long.
"""

from __future__ import annotations

import base64
import heapq
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depscope.llm.common import ship
from depscope.llm.pretokens import Memo, Splitter

_MASK = (1 << 64) - 1
_MIX = 0x9E3779B97F4A7C15


class PerfectHash:
    """Minimal perfect hash by hash and displace: slot(key) is a bijection from the keys to 0..n-1.

    Keys fall into buckets; a bucket of several keys has a displacement under which all its keys
    get free slots, found for large buckets first, and a bucket of one key names its slot.
    """

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = max(1, self.n // 3)
        by_bucket: dict[int, list[int]] = {}
        for key in keys:
            h = xxhash.xxh64_intdigest(key)
            by_bucket.setdefault(h % self.buckets, []).append(h)
        self.shift = [0] * self.buckets
        free = bytearray(b"\1") * self.n
        single = []
        for bucket, hashes in sorted(by_bucket.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(hashes) == 1:
                single.append(bucket)
                continue
            d = 1
            while True:
                slots = [self._slot(h, d) for h in hashes]
                if all(free[s] for s in slots) and len(set(slots)) == len(slots):
                    break
                d += 1
                if d > 1 << 22:
                    raise ValueError("keys repeat")
            self.shift[bucket] = d
            for s in slots:
                free[s] = 0
        left = (s for s in range(self.n) if free[s])
        for bucket in single:
            self.shift[bucket] = -next(left) - 1

    def _slot(self, h: int, d: int) -> int:
        h = ((h ^ (d * _MIX)) * _MIX) & _MASK
        return (h >> 29) % self.n

    def slot(self, key: bytes) -> int:
        """The slot of a key; of other byte strings, some slot."""
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        return -d - 1 if d < 0 else self._slot(h, d)


def read_ranks(path: str) -> list[bytes]:
    """Tokens by id from a rank file: lines of a token in base64 and its rank, which run from 0."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    if sorted(found) != list(range(len(found))):
        raise ValueError(f"{path}: ranks have gaps")
    return [found[i] for i in range(len(found))]


class Vocabulary:
    """Encoder and decoder for the tokens of a rank file.

    Entries that merging does not arrive at (none in well-formed files) are left out of the
    perfect hash, so that the shortcut for whole entries is exact.
    """

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens)}
        whole = [t for i, t in enumerate(tokens) if len(t) == 1 or self.merge(t) == [i]]
        self.hash = PerfectHash(whole)
        self.at = [(b"", -1)] * len(whole)
        for t in whole:
            self.at[self.hash.slot(t)] = (t, self.ranks[t])
        self.pattern = pattern
        self._open()

    def _open(self):
        self.split, self.memo = Splitter(self.pattern), Memo(self.encode_match, 250_000)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "memo")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._open()

    def merge(self, word: bytes) -> list[int]:
        """Ids of a byte string: merge the pair of lowest rank, the leftmost of these, until none is left."""
        n, ranks = len(word), self.ranks
        end = list(range(1, n + 1))  # where the part that starts here ends; 0: no part starts here
        start = list(range(-1, n))  # where the part that ends here starts
        heap = []
        for i in range(n - 1):
            r = ranks.get(word[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 1, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if end[i] != j or end[j] != k:
                continue
            end[i], end[j] = k, 0
            start[k] = i
            if k < n:
                e = end[k]
                r = ranks.get(word[i:e])
                if r is not None:
                    heapq.heappush(heap, (r, i, k, e))
            if i:
                b = start[i]
                r = ranks.get(word[b:k])
                if r is not None:
                    heapq.heappush(heap, (r, b, i, k))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def encode_match(self, match: str) -> bytes:
        word = match.encode()
        token, i = self.at[self.hash.slot(word)]
        if token == word:
            return struct.pack("<I", i)
        return struct.pack(f"<{len(ids := self.merge(word))}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null counts as empty."""
        return b"".join([self.memo.ids(part) for part in self.split(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _round_trip(batches, broadcast, rows: int = 256):
    v = broadcast.value  # one object per Python worker: its memo lasts from task to task
    for whole in batches:
        for i in range(0, whole.num_rows, rows):
            batch = whole.slice(i, rows)
            ids = [v.encode(t) for t in batch.column(1).to_pylist()]
            text = [v.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(text, pa.binary())], ["id", "ids", "decoded"])


def bpe_round_trip(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded) of every row's text.

    ids: little-endian unsigned 32-bit integers as binary. decoded: the bytes that these ids
    stand for. Null text counts as empty: no ids, no bytes. Ids of rows are passed through,
    null or repeated; equal texts have equal ids. Texts are read whole: long ones are split piece by piece. Other columns are
    not read. An empty table gives no rows. The vocabulary (its size does not depend on the data) is broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    broadcast = spark.sparkContext.broadcast(Vocabulary(read_ranks(vocabulary_path), pattern))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(lambda batches: _round_trip(batches, broadcast), f"id {kind}, ids binary, decoded binary")
    return out.select("id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")
