"""SimHash near-duplicates: fingerprints with numpy, links by vantage-point trees (``vantage``).

A link is a Hamming distance of at most ``radius`` (3) between 64-bit fingerprints. If two
fingerprints are that close, one of their two 32-bit halves differs in ``radius // 2`` (1) bits at
most, so the trees are on halves, and no link is lost. Equal fingerprints are one node. Links never leave
their shard as pairs, only as spanning forests; connected components join these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depscope.llm.common import rows_of, ship, written
from depscope.llm.components import connected_components, join_hot
from depscope.llm.vantage import Search, hamming_links

SEED = 42
_SPACED = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, words: int = 3) -> list[int]:
    """XXH64 (seed 42) of every shingle of ``words`` words of the text; fewer words: of all of them."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return []
    line = b" ".join(parts)
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(line, SEED)]
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(gaps[: len(parts) - words] + 1).tolist()]
    ends = [*gaps[words - 1 :].tolist(), len(line)]
    digest = xxhash.xxh64_intdigest
    return [digest(line[s:e], SEED) for s, e in zip(starts, ends, strict=True)]


def majority_bits(hashes: np.ndarray) -> int:
    """The number whose bits are 1 where over half of the hashes have a 1; zero of none.

    Bits are counted eight at a time, in bytes of 64-bit sums of at most 255 terms.
    """
    n = len(hashes)
    if not n:
        return 0
    cuts = np.arange(0, n, 255)
    counts = np.empty((8, 8), np.int64)  # [bit in byte][byte]
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & _SPACED, cuts)
        counts[k] = sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    on = (counts * 2 > n).T.reshape(-1)  # bit i of the number at i
    return int(np.packbits(on, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of a text. Null and blank texts have fingerprint 0."""
    return majority_bits(np.array(shingle_hashes(text, words), np.uint64))


def _fingerprints(batches, words: int):
    for batch in batches:
        out = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of every row's text, as a signed long."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string"))
    return rows.mapInArrow(lambda batches: _fingerprints(batches, words), "id long, fp long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 3, radius: int = 3, leaf_rows: int = 1 << 15) -> DataFrame:
    """(id, fp, component_id) for every row: component_id is the smallest id reachable by links.

    Null and blank texts have fingerprint 0, which links like any other. Equal fingerprints are
    one node, so copies cost nothing. A null id is never the smallest unless there is no other.
    Rows that repeat an id each have their row. Texts are read whole, however long. Ties (equal texts) share a
    fingerprint. Only the two columns named are read, so others cannot clash. An empty table gives no rows.
    """
    thin = written(fingerprints(docs, id_col, text_col, words=words))
    groups = written(thin.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    nodes = groups.select(F.col("fp").alias("node"), F.col("fp").alias("f0"))
    labels = connected_components(hamming_links(nodes, Search(1, 32, radius // 2, radius), leaf_rows=leaf_rows))
    linked = groups.join(labels.withColumnRenamed("node", "fp"), "fp").select("fp", "rep", "label")
    sizes = written(linked.groupBy("label").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("fps")))
    total = sizes.agg(F.sum("fps")).first()[0] or 0
    linked = join_hot(linked, sizes, "label", "fps", F.col("fp"), total).select("fp", "component_id")
    groups = groups.join(linked, "fp", "left").select("fp", "copies", F.coalesce("component_id", "rep").alias("component_id"))
    rows = groups.agg(F.sum("copies")).first()[0] or 0
    return join_hot(thin, groups, "fp", "copies", F.col("id"), rows)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, one each, with the columns of ``docs``.

    Rows with a null id stay only if nothing they link with has an id. Other cases as in
    ``simhash_components``.
    """
    found = written(simhash_components(docs, id_col, text_col, **options).select("id", "component_id"))
    return rows_of(docs, id_col, text_col, found, F.col("id").eqNullSafe(F.col("component_id")))
