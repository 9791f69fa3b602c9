"""Consistent-hash ring with virtual nodes and bounded loads, as DataFrame operations.

Positions on the ring are signed 64-bit hashes. Every shard owns ``vnodes`` virtual nodes; a key belongs to
the next node clockwise. A shard has a capacity: first each node takes its own keys, in ring order, until
its shard is full; what is left continues clockwise, past full shards, to the next that has room.

The capacities are those of exact balance: rows / shards, one more for as many shards as the
remainder. So every shard ends full, and counts differ by one at most (the law ``rows``). A key
moves away from its own node only as far as the fullness of the shards on its way forces it to.

The walk itself needs the number of keys per node only: shards * vnodes numbers, whatever the
input. They are the only thing the driver sees; what comes back is a table of
(node, ranks from-to) -> (shard, first slot), of a bounded size too, which is broadcast. Rows find their node
in a broadcast table of equal segments of the ring, each with the nodes in it. Ranks
within a node come from a window over thin rows (id, position, size, checksum), so texts are
never shuffled, and no key can be hot because positions are hashes of ids.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ring_nodes(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, in ring order. No two share a position."""
    if shards < 1 or vnodes < 1:
        raise ValueError("a ring needs shards with virtual nodes")
    at: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            digest, again = hashlib.sha256(f"shard {shard} node {v}".encode()).digest(), 8
            while (position := int.from_bytes(digest[again - 8 : again], "big", signed=True)) in at:
                again += 8
            at[position] = shard
    return sorted(at.items())


def bounded_walk(counts: dict[int, int], nodes: list[tuple[int, int]], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(node, first rank, end rank, shard, first slot): where each node's keys end up.

    ``counts``: keys by the number of their node; their ranks run from 0. Two turns of the ring are enough,
    as the second one passes every shard. Raises ValueError if the shards on the ring have no room for all keys.
    """
    used, out, left = [0] * len(capacity), [], {}

    def put(node: int, first: int, end: int, shard: int) -> int:
        """Give the shard what it has room for; returns the first rank that is left."""
        n = min(end - first, capacity[shard] - used[shard])
        if n > 0:
            out.append((node, first, first + n, shard, used[shard]))
            used[shard] += n
        return first + max(n, 0)

    for i, (_, shard) in enumerate(nodes):
        if n := counts.get(i, 0):
            rest = put(i, 0, n, shard)
            if rest < n:
                left[i] = (i, rest, n)
    queue: list[tuple[int, int, int]] = []
    head = 0
    for i, (_, shard) in [*enumerate(nodes)] * 2:
        while head < len(queue) and used[shard] < capacity[shard]:
            node, first, end = queue[head]
            first = put(node, first, end, shard)
            queue[head] = (node, first, end)
            head += first == end
        if i in left:
            queue.append(left.pop(i))
    if head < len(queue):
        raise ValueError("the shards have no room for all keys")
    return out


def _literal_rows(spark: SparkSession, rows: list, kind: str) -> DataFrame:
    """A table of one column p from numbers that the driver has, without a job."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<{kind}>")).alias("p"))


def _with_node(docs: DataFrame, position: Column, nodes: list[tuple[int, int]]) -> DataFrame:
    """Add __spot and __node, the number of the first node at or after it."""
    bits = max(1, (4 * len(nodes) - 1).bit_length())
    inside: list[list[int]] = [[] for _ in range(1 << bits)]
    for p, _ in nodes:
        inside[(p + (1 << 63)) >> (64 - bits)].append(p)
    segments, before = [], 0
    for i, positions in enumerate(inside):
        segments.append([i, before, *positions])
        before += len(positions)
    table = _literal_rows(docs.sparkSession, segments, "array<bigint>")
    table = table.select(F.col("p")[0].cast("int").alias("__of"), F.col("p")[1].cast("int").alias("__before"), F.slice("p", 3, F.greatest(F.size("p") - 2, F.lit(0))).alias("__nodes"))
    rows = docs.withColumn("__spot", position)
    rows = rows.withColumn("__segment", (F.shiftrightunsigned("__spot", 64 - bits).cast("int") + (1 << (bits - 1))) % (1 << bits))
    rows = rows.join(F.broadcast(table), F.col("__segment") == F.col("__of"))
    passed = F.size(F.filter("__nodes", lambda p: p < F.col("__spot")))
    return rows.withColumn("__node", (F.col("__before") + passed) % len(nodes)).drop("__segment", "__of", "__before", "__nodes")


def shard_rows(docs: DataFrame, id_col: str = "doc_id", *, shards: int = 24, vnodes: int = 64) -> DataFrame:
    """``docs`` with shard and slot added (slots of a shard have no gaps, from 0).

    Rows without an id have their position by all their columns. Rows that repeat an id are keys of their own at one
    position, ordered by a hash of all their columns, so they may part at a shard's limit; rows equal in every column
    are interchangeable. An empty table gives no rows. Columns named shard or slot are replaced; columns of
    any length are only hashed.
    """
    spark = docs.sparkSession
    nodes = ring_nodes(shards, vnodes)
    own = docs.drop("shard", "slot")
    every = F.xxhash64(F.lit("row"), *[F.col(c) for c in own.columns])
    spot = F.when(F.col(id_col).isNull(), every).otherwise(F.xxhash64(F.lit("ring"), F.col(id_col)))
    placed = _with_node(own.select(F.col(id_col), *[c for c in own.columns if c != id_col]), spot, nodes)
    counts = {r["__node"]: r["n"] for r in placed.groupBy("__node").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    spec = _literal_rows(spark, [[*x] for x in bounded_walk(counts, nodes, capacity)], "array<bigint>")
    where = spec.select(
        F.col("p")[0].cast("int").alias("__of"), F.col("p")[1].alias("__first"), F.col("p")[2].alias("__end"), F.col("p")[3].cast("int").alias("__shard"), F.col("p")[4].alias("__slot")
    )
    order = Window.partitionBy("__node").orderBy("__spot", id_col, "__tie")
    ranked = placed.withColumn("__tie", every).withColumn("__rank", F.row_number().over(order).cast("long") - 1)
    within = (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__end"))
    joined = ranked.join(F.broadcast(where), (F.col("__node") == F.col("__of")) & within)
    return joined.select(*own.columns, F.col("__shard").alias("shard"), (F.col("__slot") + F.col("__rank") - F.col("__first")).alias("slot"))
