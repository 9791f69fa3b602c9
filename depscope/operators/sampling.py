"""Samples of an exact size, and stable row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Above so many rows, sampling as in ``policy_sample`` applies.
SAMPLE_THRESHOLD = SAMPLE_SIZE = 10_000


def fixed_sample(df: DataFrame, k: int, id_col: str, seed: int = 42) -> DataFrame:
    """Exactly k rows (all, if there are fewer), uniform without replacement, with row_id 0.. in the order of ids.

    The rows are the first k by a hash of seed and id: tasks send k rows each at most.
    """
    order = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))
    chosen = df.orderBy(order, id_col).limit(k)
    return chosen.withColumn("row_id", F.row_number().over(Window.orderBy(id_col)).cast("long") - 1)


def policy_sample(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """The sample used for small-machine comparisons: 10,000 rows of tables that have more."""
    return fixed_sample(df, SAMPLE_SIZE, id_col, seed) if df.limit(SAMPLE_THRESHOLD + 1).count() > SAMPLE_THRESHOLD else df


def reindex_violations(sample: DataFrame, violations: DataFrame, id_col: str) -> DataFrame:
    """(row_id): the sample's numbers of the rows that ``violations`` (row_id: old ids) names."""
    old = violations.select(F.col("row_id").alias("__old")).distinct()
    return sample.join(old, F.col(id_col) == F.col("__old"), "left_semi").select("row_id")


def with_row_ids(df: DataFrame) -> DataFrame:
    """``df`` with row_id 0.. in its partitions' order, for inputs without an id.

    One pass counts rows per partition; the offsets are a row per partition.
    """
    spark = df.sparkSession
    parts = df.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = sorted((r["__p"], r["n"]) for r in parts.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, at = [], 0
    for p, n in sizes:
        offsets.append((p, at))
        at += n
    table = spark.createDataFrame(offsets, "__p int, __offset long")
    return parts.join(F.broadcast(table), "__p").withColumn("row_id", F.col("__offset") + F.col("__i")).drop("__p", "__i", "__offset")
