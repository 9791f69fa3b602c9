"""A file of token ids in shuffled bit or byte planes, with an index of its chunks.

Layout (integers little endian):

    magic                 8 bytes, ``IDPLANE1``
    blocks                each: its planes one after another, each compressed by zstandard
    documents             one zstandard frame: n ids (int64), n lengths (uint64), n times 1 or, for a null id, 0 (uint8)
    index                 per block: first id's number (uint64), place (uint64), ids (uint32),
                          then the compressed length of each of its planes (uint32; 0: all zero)
    footer                40 bytes: places of documents and index (uint64), blocks (uint64), ids (uint64),
                          ids per block (uint32), width of a plane in bits (uint16: 8 or 1), planes (uint16)
    magic                 8 bytes

A block is transposed before compression: plane p of width 8 has byte p of every id, plane p of
width 1 has bit p of every id, eight ids to a byte. High planes of small ids are zero and take
no space. A range of ids is read by decoding the blocks that it touches, and no others.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import zstandard

MAGIC = b"IDPLANE1"
_FOOTER = struct.Struct("<QQQQIHH")


def split_planes(ids: np.ndarray, width: int) -> list[bytes]:
    """The planes of a block of uint32 ids, lowest first; empty where all bits are zero."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if width == 8:
        planes = np.ascontiguousarray(octets.T)
    else:
        planes = np.packbits(np.ascontiguousarray(np.unpackbits(octets, axis=1, bitorder="little").T), axis=1, bitorder="little")
    return [p.tobytes() if p.any() else b"" for p in planes]


def join_planes(planes: list[bytes], n: int, width: int) -> np.ndarray:
    """Inverse of ``split_planes``."""
    size = n if width == 8 else (n + 7) // 8
    stack = np.zeros((len(planes), size), np.uint8)
    for i, p in enumerate(planes):
        if p:
            stack[i] = np.frombuffer(p, np.uint8)
    if width == 8:
        octets = np.ascontiguousarray(stack.T)
    else:
        bits = np.unpackbits(stack, axis=1, count=n, bitorder="little")
        octets = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return octets.reshape(-1).view("<u4")


class PlaneWriter:
    """Writes documents of ids to a binary stream; holds one block of ids in memory."""

    def __init__(self, stream, *, block: int = 1 << 17, width: int = 8, level: int = 3):
        if width not in (1, 8):
            raise ValueError("planes are 1 or 8 bits wide")
        self.stream, self.block, self.width = stream, block, width
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.index: list[bytes] = []
        self.place = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.place += len(data)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, "<u4")
        whole = len(ids) if last else len(ids) // self.block * self.block
        for i in range(0, whole, self.block):
            part = ids[i : min(i + self.block, whole)]
            packed = [self.zstd.compress(p) if p else b"" for p in split_planes(part, self.width)]
            self.index.append(struct.pack("<QQI", self.n_ids, self.place, len(part)) + struct.pack(f"<{len(packed)}I", *map(len, packed)))
            self._put(b"".join(packed))
            self.n_ids += len(part)
        self.waiting, self.n_waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        """Write what waits, the tables and the footer. The stream stays open."""
        self._flush(last=True)
        docs_at = self.place
        docs = [0 if d is None else d for d in self.docs]
        known = bytes(d is not None for d in self.docs)
        self._put(self.zstd.compress(np.array(docs, "<i8").tobytes() + np.array(self.lengths, "<u8").tobytes() + known))
        index_at = self.place
        self._put(b"".join(self.index))
        self._put(_FOOTER.pack(docs_at, index_at, len(self.index), self.n_ids, self.block, self.width, 4 if self.width == 8 else 32) + MAGIC)


class PlaneFile:
    """Reads the bytes of a file that ``PlaneWriter`` wrote."""

    def __init__(self, data: bytes | memoryview):
        self.data = data = memoryview(data)
        if bytes(data[:8]) != MAGIC or bytes(data[-8:]) != MAGIC:
            raise ValueError("not a file of id planes, or cut short")
        docs_at, index_at, blocks, self.n_ids, self.block, self.width, planes = _FOOTER.unpack(data[-8 - _FOOTER.size : -8])
        self.zstd = zstandard.ZstdDecompressor()
        table = self.zstd.decompress(data[docs_at:index_at]) if index_at > docs_at else b""
        n = len(table) // 17
        docs = np.frombuffer(table[: 8 * n], "<i8").tolist()
        self.docs = [d if known else None for d, known in zip(docs, table[16 * n :], strict=True)]
        self.lengths = np.frombuffer(table[8 * n : 16 * n], "<u8").astype(np.int64)
        row = struct.Struct(f"<QQI{planes}I")
        self.index = [row.unpack_from(data, index_at + i * row.size) for i in range(blocks)]

    def block_ids(self, i: int) -> np.ndarray:
        _, place, n, *lengths = self.index[i]
        planes = []
        for length in lengths:
            planes.append(self.zstd.decompress(self.data[place : place + length]) if length else b"")
            place += length
        return join_planes(planes, n, self.width)

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from number ``start`` on."""
        if not 0 <= start <= start + count <= self.n_ids:
            raise IndexError("beyond the file")
        if not count:
            return np.empty(0, "<u4")
        first, last = start // self.block, (start + count - 1) // self.block
        got = np.concatenate([self.block_ids(i) for i in range(first, last + 1)])
        return got[start - first * self.block :][:count]

    def documents(self):
        """Yield (document, number of its first id, its ids) in file order, a block in memory at a time."""
        start, at, have, base = 0, 0, np.empty(0, "<u4"), 0
        for doc, n in zip(self.docs, self.lengths.tolist(), strict=True):
            parts = []
            need = n
            while need:
                if base == len(have):
                    have, base, at = self.block_ids(at), 0, at + 1
                part = have[base : base + need]
                parts.append(part)
                base += len(part)
                need -= len(part)
            yield doc, start, parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, "<u4")
            start += n


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
