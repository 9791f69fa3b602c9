"""Connected components of a graph too large for one machine.

Every round orders the nodes anew by a hash, merges each node into the first of itself and its
neighbours, and keeps the edges between different merged nodes. A constant share of the nodes
goes away in a round, whatever the shape of the graph, so the rounds grow with its logarithm and
their cost falls geometrically. Hubs cost nothing special: the minimum over neighbours is
combined before the shuffle, and joins split large keys. Each round's tables are written to
shared storage; the driver sees only their row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depscope.llm.common import remove, shared_dir, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): equal labels, the id of some node, if connected.

    Loops and repeated edges are allowed. Nodes are integers and not null.
    """
    spark = edges.sparkSession
    root = shared_dir(spark)
    ends = edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
    ends = written(ends.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{root}/e0")
    maps: list[DataFrame] = []
    while ends.limit(1).count():
        k = len(maps)
        both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = F.xxhash64(F.lit(k), "b")
        first = both.groupBy("a").agg(F.min(F.struct(order.alias("h"), F.col("b").alias("id"))).alias("first"))
        own = F.struct(F.xxhash64(F.lit(k), "a").alias("h"), F.col("a").alias("id"))
        merged = written(first.select(F.col("a").alias("node"), F.least(own, F.col("first"))["id"].alias("into")), f"{root}/m{k}")
        maps.append(merged)
        at_a = merged.select(F.col("node").alias("a"), F.col("into").alias("x"))
        at_b = merged.select(F.col("node").alias("b"), F.col("into").alias("y"))
        left = ends.join(at_a, "a").join(at_b, "b").filter("x <> y")
        left = left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        ends = written(left, f"{root}/e{k + 1}")
        remove(spark, f"{root}/e{k}")
    if not maps:
        return ends.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = maps[-1].select("node", F.col("into").alias("label"))
    for merged in reversed(maps[:-1]):
        later = labels.select(F.col("node").alias("into"), "label")
        labels = merged.join(later, "into", "left").select("node", F.coalesce("label", "into").alias("label"))
    return written(labels)


def join_hot(rows: DataFrame, lookup: DataFrame, key: str, weight: str, spread, total: int, hot_share: int = 1000) -> DataFrame:
    """Left join of ``rows`` to ``lookup``, which has each ``key`` once, where some keys are very frequent.

    ``weight``: the column of lookup with the number of rows of the key; it is not returned. Keys
    with one row in ``hot_share`` or more, of which there are ``hot_share`` at most, are joined
    by broadcast, and their rows are dealt by ``spread``, an expression over rows, in the join
    of all others.
    """
    add = [c for c in lookup.columns if c not in (key, weight)]
    is_hot = (F.col(weight) * hot_share >= F.lit(total)) & (F.col(weight) > 1)
    hot = lookup.filter(is_hot).select(F.col(key).alias("__k"), F.lit(1).alias("__hot"), *[F.col(c).alias(f"__hot_{c}") for c in add])
    # Not a plain literal: as one, the optimiser would make it a filter and deal rows by the key alone.
    zero = F.when(F.col(weight) > 0, 0).otherwise(-1)
    rest = lookup.filter(~is_hot).select(F.col(key).alias("__k"), zero.alias("__salt"), *[F.col(c).alias(f"__rest_{c}") for c in add])
    out = rows.join(F.broadcast(hot), rows[key] == hot["__k"], "left").drop("__k")
    salt = F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(F.shiftrightunsigned(F.xxhash64(spread), 34).cast("int") + 1)
    out = out.withColumn("__salt", salt)
    out = out.join(rest, (out[key] == rest["__k"]) & (out["__salt"] == rest["__salt"]), "left")
    pick = [F.when(F.col("__hot").isNotNull(), F.col(f"__hot_{c}")).otherwise(F.col(f"__rest_{c}")).alias(c) for c in add]
    return out.select(*[rows[c] for c in rows.columns], *pick)
