"""Links between fingerprints within a Hamming distance, by vantage-point trees over their blocks.

A fingerprint is cut into equal blocks. Fingerprints that are close have a block in which they are
closer still: of ``count`` blocks one differs in ``radius // count`` bits at most. So each block has a
vantage-point tree of its own: a node has a vantage point v and a radius m, and fingerprints go
inside (distance of their block to v at most m) or outside. By the triangle inequality a query within
``reach`` has to enter the inside only if its distance is at most m + reach, the outside only if it is
more than m - reach. The same search on whole fingerprints would have to enter both sides at nearly every node.

The leaves are the shards. Each fingerprint is stored in its own leaf of each tree and sent as a
query to every leaf that its bound allows, so shards whose balls overlap meet. In a shard, a query looks up
the stored blocks within its reach and compares whole fingerprints. A shard returns a spanning
forest of its links, no more rows than it has fingerprints. It is built in two steps, so that a dense
group does not cost the square of its size: first every query meets two fingerprints of each block value in its
reach, then the pairs that these links have not connected, and only those, are compared one by one.

With ``reach = radius // count`` no link is lost, whatever the trees look like: they come from a
bounded sample, which decides on the sizes of shards only.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depscope.llm.common import hash_sample, ship
from depscope.llm.forest import Forest

#: Tasks of a leaf; a leaf's number and its task are parts of the number of a cell.
TASKS = 4096


class Search(NamedTuple):
    """Fingerprints of ``words`` 64-bit words in blocks of ``bits`` bits (16 or 32); links differ in ``radius`` bits at most."""

    words: int
    bits: int
    reach: int
    radius: int

    @property
    def count(self) -> int:
        return 64 * self.words // self.bits

    def blocks(self, fp: np.ndarray) -> np.ndarray:
        """[fingerprint, block] of [fingerprint, word]."""
        return np.ascontiguousarray(fp).view(f"<u{self.bits // 8}").reshape(len(fp), self.count)

    def masks(self) -> list[int]:
        """All differences of a block within reach, the smallest first."""
        return [sum(1 << b for b in some) for k in range(self.reach + 1) for some in itertools.combinations(range(self.bits), k)]


class Node:
    """A vantage point with its radius and two sides, or a leaf with its number and number of tasks."""

    __slots__ = ("inside", "leaf", "outside", "point", "radius", "tasks")

    def __init__(self, point=None, radius=None, inside=None, outside=None, leaf=None, tasks=1):
        self.point, self.radius, self.inside, self.outside, self.leaf, self.tasks = point, radius, inside, outside, leaf, tasks

    def __reduce__(self):
        return Node, (self.point, self.radius, self.inside, self.outside, self.leaf, self.tasks)


def build_tree(codes: np.ndarray, scale: float, leaf_rows: int, reach: int, rng: np.random.Generator, leaves: list[Node]) -> Node:
    """Tree over a sample of blocks, each standing for ``scale`` fingerprints; appends its leaves."""
    n = len(codes)
    if n * scale > leaf_rows and n > 1:
        best = None
        for point in rng.choice(codes, min(8, n), replace=False):
            d = np.bitwise_count(codes ^ point)
            upto = np.cumsum(np.bincount(d, minlength=8 * codes.itemsize + 1))
            for m in range(int(d.min()), int(d.max())):
                # Rows in the larger side and at the boundary are what the next levels have to do.
                both = upto[min(m + reach, len(upto) - 1)] - (upto[m - reach] if m >= reach else 0)
                cost = max(upto[m], n - upto[m]) + both
                if best is None or cost < best[0]:
                    best = (cost, point, m, d)
        if best and best[0] < 1.8 * n:
            _, point, m, d = best
            sides = [build_tree(codes[s], scale, leaf_rows, reach, rng, leaves) for s in (d <= m, d > m)]
            return Node(int(point), m, *sides)
    node = Node(leaf=len(leaves), tasks=min(TASKS, max(1, int(np.ceil(n * scale / (4 * leaf_rows))))))
    leaves.append(node)
    return node


def route(node: Node, codes: np.ndarray, rows: np.ndarray, reach: int, home: np.ndarray):
    """Yield (leaf, rows, their home flags): every leaf that a query within ``reach`` has to visit."""
    if not len(rows):
        return
    if node.leaf is not None:
        yield node, rows, home
        return
    d = np.bitwise_count(codes[rows] ^ codes.dtype.type(node.point)).astype(np.int16)
    near, far = d <= node.radius + reach, d > node.radius - reach
    yield from route(node.inside, codes, rows[near], reach, (home & (d <= node.radius))[near])
    yield from route(node.outside, codes, rows[far], reach, (home & (d > node.radius))[far])


def _columns(batch, words: int) -> np.ndarray:
    """[row, word] of the last columns of a batch or table."""
    columns = batch.columns[-words:]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return np.stack([np.asarray(c).view(np.uint64) for c in columns], 1)


def _routed(batches, shared, search: Search):
    trees = shared.value
    names = ["cell", "home", "node", *[f"f{w}" for w in range(search.words)]]
    for batch in batches:
        node, fp = np.asarray(batch.column(0)), _columns(batch, search.words)
        codes, every = search.blocks(fp), np.arange(len(fp))
        for b, tree in enumerate(trees):
            own = np.ascontiguousarray(codes[:, b])
            cells, kinds, sent = [], [], []
            for leaf, rows, home in route(tree, own, every, search.reach, np.ones(len(fp), bool)):
                salt = (fp[rows, 0] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(leaf.tasks)
                first = (b << 44) + leaf.leaf * TASKS
                cells += [first + salt.astype(np.int64), *[np.full(home.sum(), first + t) for t in range(leaf.tasks)]]
                kinds += [np.zeros(len(rows), bool), *[np.ones(home.sum(), bool)] * leaf.tasks]
                sent += [rows, *[rows[home]] * leaf.tasks]
            if sent:
                at = np.concatenate(sent)
                columns = [np.concatenate(cells), np.concatenate(kinds), node[at], *fp[at].T.copy().view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def expand(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range, place) of every place in the ranges start..end."""
    n = end - start
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) + np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n)


def _pieces(n: np.ndarray, block: int):
    """Yield slices of ranges of these lengths that hold about ``block`` places each."""
    total = np.cumsum(n)
    first = 0
    while first < len(n):
        end = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + block, "right")))
        yield slice(first, end)
        first = end


class Shard:
    """The stored fingerprints of a leaf, for looking up those of a block value, and the links found."""

    def __init__(self, fp: np.ndarray, code: np.ndarray, member: np.ndarray, forest: Forest, radius: int):
        self.fp, self.code, self.member, self.forest, self.radius = fp, code.astype(np.uint64), member, forest, radius
        self.order()

    def order(self) -> None:
        """Sort by block value, and those of one value by the group that they belong to so far."""
        self.keys = self.code << np.uint64(32) | self.forest.root[self.member].astype(np.uint64)
        self.place = np.argsort(self.keys)
        self.keys = self.keys[self.place]

    def links(self, fp: np.ndarray, member: np.ndarray, at: np.ndarray) -> int:
        """Unite each query with the stored fingerprint at its place, where they are close. Returns the number of links."""
        kept, d = np.arange(len(at)), 0
        for w in range(fp.shape[1]):
            d = d + np.bitwise_count(fp[kept, w] ^ self.fp[at[kept], w]).astype(np.int64)
            near = d <= self.radius
            kept, d = kept[near], d[near]
        self.forest.add(member[kept], self.member[at[kept]])
        return len(kept)

    def search(self, fp: np.ndarray, code: np.ndarray, member: np.ndarray, masks: list[int], block: int = 1 << 19) -> None:
        """Connect the queries with all stored fingerprints that are close and have a block in their reach."""
        code = code.astype(np.uint64)
        spread = (fp[:, 0] >> np.uint64(17)).astype(np.int64)
        low = np.uint64(0xFFFFFFFF)
        for mask in masks:
            key = (code ^ np.uint64(mask)) << np.uint64(32)
            start, end = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key | low, "right")
            some = np.flatnonzero(end > start)
            start, end = start[some], end[some]
            self.links(fp[some], member[some], self.place[start])
            self.links(fp[some], member[some], self.place[start + spread[some] % (end - start)])
        stale = True
        for mask in masks:
            if stale:
                self.order()
            stale = False
            # Every other pair with this difference is met from its other end.
            some = np.flatnonzero((code ^ np.uint64(mask)) >= code)
            key = (code[some] ^ np.uint64(mask)) << np.uint64(32)
            start, end = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key | low, "right")
            there = end > start
            some, key, start, end = some[there], key[there], start[there], end[there]
            # Those of the query's own group are one stretch.
            own = key | self.forest.root[member[some]].astype(np.uint64)
            a, b = np.searchsorted(self.keys, own), np.searchsorted(self.keys, own, "right")
            for lo, hi in ((start, a), (b, end)):
                for part in _pieces(hi - lo, block):
                    of, place = expand(lo[part], hi[part])
                    q = some[part][of]
                    stale |= self.links(fp[q], member[q], self.place[place]) > 0


def _shard_links(table: pa.Table, search: Search) -> pa.Table:
    block = table.column("cell")[0].as_py() >> 44
    fp = _columns(table, search.words)
    home = np.asarray(table.column("home").combine_chunks().cast(pa.uint8())).astype(bool)
    nodes, member = np.unique(np.asarray(table.column("node").combine_chunks()), return_inverse=True)
    code = search.blocks(fp)[:, block]
    forest = Forest(len(nodes))
    if home.any() and not home.all():
        shard = Shard(fp[home], code[home], member[home], forest, search.radius)
        shard.search(fp[~home], code[~home], member[~home], search.masks())
    child = np.flatnonzero(forest.root != np.arange(len(nodes)))
    return pa.table({"a": pa.array(nodes[forest.root[child]]), "b": pa.array(nodes[child])})


def hamming_links(fps: DataFrame, search: Search, *, leaf_rows: int = 1 << 15, sample: tuple[int, int] = (20_000, 1_000_000), seed: int = 7) -> DataFrame:
    """Edges (a, b) of nodes that connect what links connect. ``fps``: node (long, not null) and words f0, f1, ...

    One row in ``leaf_rows / 4``, but at least and at most ``sample`` rows, go to the driver to place
    vantage points. At 1e6, 2e7 and 1e9 fingerprints that is 20,000, 20,000 and 122,070 rows, and a leaf has about
    ``leaf_rows`` fingerprints, as each side of a tree stands for at least four sampled ones.
    """
    spark = fps.sparkSession
    ship(spark)
    words = [f"f{w}" for w in range(search.words)]
    n = fps.count()
    least, most = sample
    drawn = hash_sample(fps, min(most, max(least, 4 * n // leaf_rows)), n, "node", *words).select(*words).toArrow()
    codes = search.blocks(_columns(drawn, search.words))
    leaf_rows = max(leaf_rows, 4 * n // max(1, len(codes)))
    rng, trees = np.random.default_rng(seed), []
    for b in range(search.count):
        trees.append(build_tree(np.ascontiguousarray(codes[:, b]), n / max(1, len(codes)), leaf_rows, search.reach, rng, []))
    shared = spark.sparkContext.broadcast(trees)
    schema = "cell long, home boolean, node long, " + ", ".join(f"{w} long" for w in words)
    routed = fps.select("node", *words).mapInArrow(lambda batches: _routed(batches, shared, search), schema)
    return routed.groupBy("cell").applyInArrow(lambda t: _shard_links(t, search), "a long, b long")
