"""Embedding near-duplicates: an exact metric range join over pivot cells.

The metric is the angle between vectors; a link is an angle of at most arccos(threshold). Every
vector belongs to the cell of its nearest pivot, and a cell of many vectors is dealt into chunks of
bounded size. Two vectors can only link if each is close enough to the other's cell. By
the triangle inequality, x need not go to cell j if

* its angle to pivot j exceeds the cell's radius (the largest angle of a member to its pivot) plus
  the linking angle, or
* its angle to pivot j exceeds that to its own pivot by more than twice the linking angle: all
  members of cell j are closer to pivot j than to x's pivot.

Each pair of chunks is one task, which gets those vectors of both that pass these bounds against
the other; so each pair of vectors meets once, and a task has two chunks at most. In it, products
are computed blockwise in single precision; whatever comes within its error of the threshold
is computed again in double precision. The task returns, for each vector with links, their
number and its representative in a spanning forest: never pairs.

How much the bounds prune depends on the data. In clustered data most pairs of cells go away. Vectors
that spread evenly in 64 dimensions are all about 90 degrees apart, and no pivot method can
separate them by 26 degrees: there nearly all chunks meet, by the square of their number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depscope.llm.common import hash_sample, ship, written
from depscope.llm.components import connected_components, join_hot
from depscope.llm.forest import Forest


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists are equally long."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    # Scaling first keeps squares of very large and very small components finite.
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


class Cells:
    """Pivots of one dimension with what the routing needs: radii, and the chunks of every cell."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.radius = np.zeros(len(pivots))
        self.chunks = np.ones(len(pivots), np.int64)
        self.first = np.zeros(len(pivots), np.int64)

    def angles(self, vectors: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(unit(vectors) @ self.pivots.T, -1, 1))


def _by_length(batch, cells: dict[int, Cells]):
    """Yield (cells, row numbers, vectors) for each length of vectors in the batch."""
    column = batch.column(batch.schema.get_field_index("vector"))
    lengths = np.asarray(column.value_lengths())
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield cells[int(length)], rows, matrix(column.take(pa.array(rows)))


def _homes(batches, cells: dict[int, Cells]):
    for batch in batches:
        for c, _, vectors in _by_length(batch, cells):
            angles = c.angles(vectors)
            home = angles.argmin(1)
            near = angles[np.arange(len(home)), home]
            found = np.unique(home)
            n = len(found)
            columns = [np.full(n, vectors.shape[1]), found, np.bincount(home)[found], [near[home == h].max() for h in found]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["length", "cell", "n", "radius"])


def _targets(batches, cells: dict[int, Cells], reach: float, slack: float = 1e-6):
    """Add to each row its chunk and all chunk pairs, as lower * 2^31 + higher, in which it takes part."""
    for batch in batches:
        reps = np.asarray(batch.column(0))
        chunk = np.empty(len(reps), np.int64)
        pairs: list = [None] * len(reps)
        for c, rows, vectors in _by_length(batch, cells):
            angles = c.angles(vectors)
            home = angles.argmin(1)
            near = angles[np.arange(len(home)), home][:, None]
            go = (angles <= c.radius + reach + slack) & (angles - near <= 2 * reach + slack) & (c.chunks > 0)
            go[np.arange(len(home)), home] = True
            part = ((reps[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % np.maximum(1, c.chunks[home])
            own = c.first[home] + part
            chunk[rows] = own
            for row, mine, cell in zip(rows.tolist(), own.tolist(), go, strict=True):
                other = np.concatenate([np.arange(c.first[j], c.first[j] + c.chunks[j]) for j in np.flatnonzero(cell)])
                pairs[row] = np.minimum(mine, other) << 31 | np.maximum(mine, other)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunk), pa.array(pairs, pa.list_(pa.int64()))], [*batch.schema.names, "chunk", "pairs"])


def _links(table: pa.Table, threshold: float, block: int = 1024) -> pa.Table:
    pair = table.column("pair")[0].as_py()
    reps, weights = np.asarray(table.column("rep")), np.asarray(table.column("copies"))
    v = unit(matrix(table.column("vector")))
    v32 = v.astype(np.float32)
    chunk = np.asarray(table.column("chunk"))
    a = np.flatnonzero(chunk == pair >> 31)
    b = np.flatnonzero(chunk == pair & (1 << 31) - 1)
    same = pair >> 31 == pair & (1 << 31) - 1
    # Rounding of inputs and of the sum: far below this for any usual number of components.
    error = 1e-6 + 2e-7 * v.shape[1]
    links, forest = np.zeros(len(reps), np.int64), Forest(len(reps))
    for i in range(0, len(a), block):
        left, right = a[i : i + block], b[i:] if same else b
        close = v32[left] @ v32[right].T
        q, s = np.nonzero(close >= threshold - error)
        if same:
            q, s = q[s > q], s[s > q]
        unsure = np.flatnonzero(close[q, s] <= threshold + error)
        sure = np.ones(len(q), bool)
        for at in np.array_split(unsure, len(unsure) // 100_000 + 1):
            sure[at] = np.einsum("ij,ij->i", v[left[q[at]]], v[right[s[at]]]) >= threshold
        x, y = left[q[sure]], right[s[sure]]
        links += np.bincount(x, weights[y], len(reps)).astype(np.int64) + np.bincount(y, weights[x], len(reps)).astype(np.int64)
        forest.add(x, y)
    some = np.flatnonzero(links)
    return pa.table({"rep": reps[some], "links": links[some], "root": reps[forest.root[some]]})


def _same_length_pivots(sample: list, cells: int) -> dict[int, Cells]:
    by_length: dict[int, list] = {}
    for row in sample:
        by_length.setdefault(len(row), []).append(row)
    out = {}
    for length, rows in by_length.items():
        v = unit(np.array(rows, np.float64))
        chosen = [0]
        nearest = v @ v[0]
        while len(chosen) < min(cells, len(v)):  # the one farthest from those chosen comes next
            i = int(nearest.argmin())
            if nearest[i] > 1 - 1e-9:
                break
            chosen.append(i)
            nearest = np.maximum(nearest, v @ v[i])
        out[length] = Cells(v[chosen])
    return out


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, threshold: float = 0.9, chunk_rows: int = 8192, least_cells: int = 12, most_cells: int = 256, sample: int = 4096) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``.

    Links are between rows whose vectors have a cosine of ``threshold`` or more, in double
    precision; n_links counts the other rows linked directly, component_id is the smallest id
    reachable. Equal vectors are linked and meet the others as one. A vector that is null, empty
    or zero, or has a null or non-finite component, links with nothing, and vectors of different
    lengths do not link. Ids are whole numbers; a null id has its row, links like others, and is never the
    smallest unless alone. Other columns are not read. An empty table gives no rows. ``sample``: so many vectors go to the driver to choose pivots from.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    usable = F.coalesce(F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("vector", F.when(usable, F.col("vector")))
    found = rows.filter(F.col("vector").isNotNull()).groupBy("vector").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    # A number of its own for each different vector, that of its smallest id where there is one.
    distinct = written(found.withColumn("rep", F.coalesce("least", F.monotonically_increasing_id() - F.lit(1 << 62))))
    kinds = distinct.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("rows")).collect()
    if not kinds:
        alone = rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        return alone.withColumn("kept", F.lit(True))
    n, total = sum(k["n"] for k in kinds), sum(k["rows"] for k in kinds)
    drawn = [r["vector"] for k in kinds for r in hash_sample(distinct.filter(F.size("vector") == k["length"]).select("vector", "rep"), max(1, sample * k["n"] // n), k["n"], "rep").collect()]
    cells = _same_length_pivots(drawn, max(least_cells, min(most_cells, math.ceil(n / chunk_rows))))
    reach = math.acos(threshold)
    first = 0
    homes = distinct.select("vector").mapInArrow(lambda b: _homes(b, cells), "length long, cell long, n long, radius double")
    sizes = {(r["length"], r["cell"]): r for r in homes.groupBy("length", "cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()}
    for length, c in sorted(cells.items()):
        for i in range(len(c.pivots)):
            size = sizes.get((length, i))
            c.radius[i] = size["radius"] if size else -10.0
            c.chunks[i] = -(-size["n"] // chunk_rows) if size else 0
            c.first[i] = first
            first += int(c.chunks[i])
    kind = distinct.schema["vector"].dataType.simpleString()
    sent = distinct.select("rep", "copies", "vector").mapInArrow(lambda b: _targets(b, cells, reach), f"rep long, copies long, vector {kind}, chunk long, pairs array<bigint>")
    sent = sent.select("rep", "copies", "vector", "chunk", F.explode("pairs").alias("pair"))
    links = written(sent.groupBy("pair").applyInArrow(lambda t: _links(t, threshold), "rep long, links long, root long"))
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = connected_components(links.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    nodes = distinct.select("rep", "least", "copies")
    linked = nodes.join(labels, "rep").select("rep", "least", "label")
    sums = written(linked.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("nodes")))
    linked = join_hot(linked, sums, "label", "nodes", F.col("rep"), sums.agg(F.sum("nodes")).first()[0] or 0).select("rep", "component_id")
    nodes = distinct.join(counts, "rep", "left").join(linked, "rep", "left")
    nodes = nodes.select("vector", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"), F.lit(1).alias("usable"))
    out = join_hot(rows, nodes, "vector", "copies", F.col("id"), total)
    component = F.when(F.col("usable").isNull(), F.col("id")).otherwise(F.col("component_id"))
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
