"""Near copies by SimHash with a wide radius, confirmed by the exact Jaccard similarity of word shingles.

A document is the set of its shingles of five words. Its fingerprint has 256 bits, and documents whose
fingerprints agree in four fifths of them (51 differing bits or fewer) are candidates. They
are found by vantage-point trees on 16 blocks of 16 bits with a reach of 1 (``vantage``), and what comes back is
a forest, so candidates are groups, not pairs. Two sets with a similarity of 0.8 differ in 39 of 256 bits on
average (standard deviation 6), and all 16 blocks differ in 2 bits or more for 1 such pair in 180; higher
similarities are surer.

Inside each group of candidates, similarity is exact: the group's sets meet in one task, through an index
of their shingles. Groups of more than ``chunk_rows`` documents are dealt into chunks, twice and differently, which
connects dense groups at a cost that grows with their size only; documents that this does not connect with
most of their group are then compared with all of it, chunk by chunk. Tasks hold two chunks at most and
return forests, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depscope.llm.common import rows_of, ship, written
from depscope.llm.components import connected_components, join_hot
from depscope.llm.forest import Forest
from depscope.llm.textvec import Words, groups, mixed
from depscope.llm.vantage import Search, expand, hamming_links

#: A null id as a node: after all others, so that it is the smallest of its group only if it is alone.
NO_ID = (1 << 63) - 1
WORDS = 4  # of 64 bits in a fingerprint
_STEP = 0x9E3779B97F4A7C15
_SPACED = np.uint64(0x0101010101010101)
#: Odd multipliers that turn one hash into several (fixed values).
_TURNS = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def shingle_sets(texts: list[str | None], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the different shingles of each text, sorted, one text after another, and their numbers.

    Words are runs without white space, lower-cased in A-Z. A text of fewer words has one shingle, of all of them.
    """
    w = Words(texts, spaced=True)
    h, doc = w.hashes(w.start, w.end), w.doc
    n = np.bincount(doc, minlength=len(texts))
    place = np.arange(len(h)) - (np.cumsum(n) - n)[doc]
    room = n[doc] - place  # words from here to the end of the text
    later = np.concatenate([h, np.zeros(words, np.uint64)])
    total = np.zeros(len(h), np.uint64)
    for k in range(words):
        total += np.where(room > k, later[k : k + len(h)] * np.uint64(pow(_STEP, k + 1, 1 << 64)), np.uint64(0))
    whole = (room >= words) | (place == 0)
    h, doc = mixed(total[whole]), doc[whole]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[fresh], np.bincount(doc[fresh], minlength=len(texts))


def wide_fingerprints(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """[text with shingles, word]: bits that are 1 in over half of a text's shingles, for the texts that have any.

    Bits are counted eight at a time, in bytes of 64-bit sums of at most 255 terms.
    """
    sizes = sizes[sizes > 0]
    begin = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    cuts = np.flatnonzero((np.arange(len(hashes)) - begin[doc]) % 255 == 0)
    first = np.searchsorted(cuts, begin)
    out = np.zeros((len(sizes), WORDS), np.uint64)
    if not len(sizes):
        return out
    for w, turn in enumerate(_TURNS):
        x = mixed(hashes * turn)
        counts = np.empty((len(sizes), 8, 8), np.int64)  # [text, byte, bit in byte]
        for k in range(8):
            sums = np.add.reduceat((x >> np.uint64(k)) & _SPACED, cuts)
            counts[:, :, k] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        on = (counts * 2 > sizes[:, None, None]).reshape(len(sizes), 64)
        out[:, w] = np.packbits(on, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _fingerprints(batches, words: int):
    names = ["node", *[f"f{w}" for w in range(WORDS)]]
    for batch in batches:
        node, texts = np.asarray(batch.column(0)), batch.column(1).to_pylist()
        for a, b in groups(texts):
            hashes, sizes = shingle_sets(texts[a:b], words)
            fp = wide_fingerprints(hashes, sizes)
            columns = [node[a:b][sizes > 0], *fp.T.copy().view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _sets(batches, words: int):
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        for a, b in groups(texts):
            hashes, sizes = shingle_sets(texts[a:b], words)
            ends = np.cumsum(sizes)
            own = pa.array([hashes[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary())
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], own], [*batch.schema.names[:-1], "shingles"])


def alike(left: list[np.ndarray], right: list[np.ndarray], t: float):
    """Yield (i, places): the sets of ``right`` whose Jaccard similarity with left[i] is at least ``t``."""
    n_right = np.array([len(s) for s in right])
    tokens = np.concatenate(right)
    owner = np.repeat(np.arange(len(right)), n_right)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    for i, own in enumerate(left):
        _, place = expand(np.searchsorted(tokens, own), np.searchsorted(tokens, own, "right"))
        both = np.bincount(owner[place], minlength=len(right))
        yield i, np.flatnonzero((both > 0) & (both * (1 + t) >= t * (len(own) + n_right) - 1e-9))


def _similar(table: pa.Table, t: float) -> pa.Table:
    """Forest of the links between the rows whose ``side`` is 0 or null and those whose side is 1 or null."""
    side = table.column("side").combine_chunks()
    node = np.asarray(table.column("node").combine_chunks())
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    left = np.flatnonzero(np.asarray(side.fill_null(0)) == 0)
    right = np.flatnonzero(np.asarray(side.fill_null(1)) == 1)
    a, b = [], []
    if len(left) and len(right):
        for i, places in alike([sets[j] for j in left], [sets[j] for j in right], t):
            a.append(np.full(len(places), left[i]))
            b.append(right[places])
    forest = Forest(len(node))
    if a:
        forest.add(np.concatenate(a), np.concatenate(b))
    child = np.flatnonzero(forest.root != np.arange(len(node)))
    return pa.table({"a": pa.array(node[forest.root[child]]), "b": pa.array(node[child])})


def candidate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, similarity: float = 0.8, leaf_rows: int = 1 << 15) -> DataFrame:
    """(node, label) of the documents whose fingerprints link with others: equal labels if links connect them."""
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("node"), F.col(text_col).cast("string").alias("text"))
    schema = "node long, " + ", ".join(f"f{w} long" for w in range(WORDS))
    fps = written(rows.mapInArrow(lambda batches: _fingerprints(batches, words), schema))
    search = Search(WORDS, 16, 1, math.floor((1 - similarity) * 64 * WORDS + 1e-9))
    return connected_components(hamming_links(fps, search, leaf_rows=leaf_rows))


def near_copy_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, similarity: float = 0.8, chunk_rows: int = 2048, leaf_rows: int = 1 << 15) -> DataFrame:
    """Links (a, b) of ids that connect the documents that similarities of at least ``similarity`` connect.

    Only documents that are in a group of candidates move, as sets of shingles. A null id is ``NO_ID``. Texts
    without words have no links.
    """
    t = similarity
    grouped = candidate_groups(docs, id_col, text_col, words=words, similarity=similarity, leaf_rows=leaf_rows)
    sizes = written(grouped.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).withColumn("chunks", F.ceil(F.col("rows") / chunk_rows).cast("int")))
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    dealt = join_hot(grouped, sizes, "label", "rows", F.col("node"), total).select(F.col("node").alias("__node"), "label", "chunks")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("node"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(dealt, F.col("node") == F.col("__node")).select("label", "chunks", "node", "text")
    members = written(rows.mapInArrow(lambda batches: _sets(batches, words), "label long, chunks int, node long, shingles binary"))

    def linked(parts: DataFrame, *keys: str) -> DataFrame:
        return parts.select(*keys, "node", "shingles", "side").groupBy(*keys).applyInArrow(lambda x: _similar(x, t), "a long, b long")

    def chunk(salt: int, n):
        return F.pmod(F.xxhash64(F.lit(salt), "node"), n).cast("int")

    alone = members.withColumn("side", F.lit(None).cast("int"))
    links = linked(alone.withColumn("chunk", chunk(0, F.col("chunks"))), "label", "chunk")
    large = alone.filter("chunks > 1")
    if not sizes.filter("chunks > 1").limit(1).count():
        return written(links)
    links = written(links.unionByName(linked(large.withColumn("chunk", chunk(1, F.col("chunks"))), "label", "chunk")))
    found = connected_components(links).withColumnRenamed("label", "part")
    placed = large.select("label", "chunks", "node").join(found, "node", "left").select("label", "chunks", "node", F.coalesce("part", "node").alias("part"))
    parts = placed.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n"))
    most = written(parts.groupBy("label").agg(F.max(F.struct("n", "part"))["part"].alias("most"), F.sum("n").alias("rows")))
    placed = join_hot(placed, most, "label", "rows", F.col("node"), total)
    few = written(placed.filter("part <> most").select("label", "node"))
    packs = few.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("packs")).join(most.select("label", "rows"), "label")
    large = join_hot(large, packs, "label", "rows", F.col("node"), total).filter("packs is not null")
    left = large.join(few.select("label", "node"), ["label", "node"], "left_semi").withColumn("side", F.lit(0))
    left = left.withColumn("pack", chunk(2, F.col("packs"))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    right = large.withColumn("side", F.lit(1)).withColumn("chunk", chunk(0, F.col("chunks"))).withColumn("pack", F.explode(F.sequence(F.lit(0), F.col("packs") - 1)))
    columns = ["label", "pack", "chunk", "node", "shingles", "side"]
    rest = linked(left.select(*columns).unionByName(right.select(*columns)), "label", "pack", "chunk")
    return written(links.unionByName(rest))


def near_copy_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, component_id) for every row: the smallest id that similarities of at least ``similarity`` reach.

    Null and blank texts have no shingles and link with nothing. Texts that differ in white space or the case of
    A-Z only are equal. A null id is the smallest only if nothing linked has an id; all null ids are one document, and so
    are rows that repeat an id. Texts are read whole. Other columns are not read. An empty table gives no rows.
    """
    labels = connected_components(near_copy_links(docs, id_col, text_col, **options))
    sizes = written(labels.groupBy("label").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("rows")))
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    parts = written(join_hot(labels, sizes, "label", "rows", F.col("node"), total).select("node", "component"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"))
    rows = rows.join(parts, F.coalesce("id", F.lit(NO_ID)) == F.col("node"), "left")
    component = F.coalesce("component", "id")
    return rows.select("id", F.when(component != NO_ID, component).alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, one each, with the columns of ``docs``.

    Cases as in ``near_copy_components``.
    """
    found = written(near_copy_components(docs, id_col, text_col, **options))
    return rows_of(docs, id_col, text_col, found, F.col("id").eqNullSafe(F.col("component_id")))
