"""Profiles of columns: distinct values, frequencies, histograms, inferred settings, sketches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depscope.functions.special import beta_skewness
from depscope.operators import counts
from depscope.spec import FDSpec

#: Relative error of a HyperLogLog sketch with 2^14 registers.
RSD_14 = 0.0081


def _unpivoted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    return df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def distinct_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, distinct_values, nulls, rows) of all columns in one scan; nulls are not values."""
    values = _unpivoted(df, columns or df.columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("c"))
    return values.groupBy("column").agg(
        F.count("value").alias("distinct_values"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("c"))), F.lit(0)).alias("nulls"), F.sum("c").alias("rows")
    )


def column_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, rows, nulls, distinct_values, least, greatest, most_frequent, frequency): values as texts.

    Of equally frequent values the smallest text counts. All columns share one scan.
    """
    values = _unpivoted(df, columns or df.columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("c"))
    known = F.col("value").isNotNull()
    top = F.min(F.when(known, F.struct((-F.col("c")).alias("minus"), "value")))
    out = values.groupBy("column").agg(
        F.sum("c").alias("rows"),
        F.coalesce(F.sum(F.when(~known, F.col("c"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct_values"),
        F.min("value").alias("least"),
        F.max("value").alias("greatest"),
        top.alias("top"),
    )
    return out.select("column", "rows", "nulls", "distinct_values", "least", "greatest", F.col("top.value").alias("most_frequent"), (-F.col("top.minus")).alias("frequency"))


def approx_distinct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(approx_distinct) of a combination of columns by HyperLogLog++."""
    return df.agg(F.approx_count_distinct(F.struct(*columns), RSD_14).alias("approx_distinct"))


def distinct_sketch(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(sketch) that can be stored and merged by hll_union; hll_sketch_estimate reads it."""
    return df.agg(F.hll_sketch_agg(F.xxhash64(*columns), 14).alias("sketch"))


def rank_frequency(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(rank, frequency) of the groups by columns, most frequent first: the series of a rank plot.

    Groups of equal size need no order among themselves, so ranks come from the histogram of
    sizes, which is small, and not from a global sort of groups.
    """
    sizes = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("frequency")).groupBy("frequency").agg(F.count(F.lit(1)).alias("groups"))
    before = F.coalesce(F.sum("groups").over(Window.orderBy(F.desc("frequency")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = sizes.select("frequency", (before + 1).alias("first"), (before + F.col("groups")).alias("last"))
    pieces = ranks.withColumn("from", F.explode(F.sequence("first", "last", F.lit(1 << 16).cast("long"))))
    return pieces.select(F.explode(F.sequence("from", F.least(F.col("last"), F.col("from") + (1 << 16) - 1))).alias("rank"), "frequency")


def count_histogram(df: DataFrame, columns: Sequence[str], bins: int = 50) -> DataFrame:
    """(bin, groups): equal-width histogram of group sizes; the last bin holds the largest size too."""
    sizes = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("frequency")).groupBy("frequency").agg(F.count(F.lit(1)).alias("groups"))
    ends = sizes.agg(F.min("frequency").cast("double").alias("lo"), F.max("frequency").cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.when(width > 0, F.least(F.floor((F.col("frequency") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    return sizes.join(F.broadcast(ends)).groupBy(bin_.cast("long").alias("bin")).agg(F.sum("groups").alias("groups"))


def infer_column_settings(df: DataFrame, column: str) -> DataFrame:
    """(tuples, cardinality, dist_alpha, dist_beta): beta distribution of rank / cardinality by moments.

    The value with the most rows has rank 0. All values of a frequency are taken together, in
    closed form, so neither values nor rows are sorted or expanded.
    """
    values = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("f"))
    sizes = values.groupBy("f").agg(F.count(F.lit(1)).alias("g"))
    before = F.coalesce(F.sum("g").over(Window.orderBy(F.desc("f")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    g, f = F.col("g").cast("double"), F.col("f").cast("double")
    ranks = g * F.col("s") + g * (g - 1) / 2
    squares = g * F.col("s") * F.col("s") + F.col("s") * g * (g - 1) + (g - 1) * g * (2 * g - 1) / 6
    sums = sizes.withColumn("s", before).agg(
        F.coalesce(F.sum(F.col("f") * F.col("g")), F.lit(0)).alias("tuples"), F.coalesce(F.sum("g"), F.lit(0)).alias("cardinality"), F.sum(f * ranks).alias("r1"), F.sum(f * squares).alias("r2")
    )
    n, card = F.col("tuples").cast("double"), F.col("cardinality").cast("double")
    mean = F.when(n > 0, F.col("r1") / n / card)
    variance = F.when(n > 1, (F.col("r2") / card / card - n * mean * mean) / (n - 1))
    flat = variance.isNull() | (variance < 1e-15)
    # Where all values have one row each the ranks vary, so a zero variance means one value.
    factor = mean * (1 - mean) / F.when(~flat, variance) - 1
    return sums.select("tuples", "cardinality", F.when(flat, 1.0).otherwise(mean * factor).alias("dist_alpha"), F.when(flat, 1.0).otherwise((1 - mean) * factor).alias("dist_beta"))


def noise_ratio(df: DataFrame, lhs: str, rhs: str) -> DataFrame:
    """(noise): share of rows outside their group's most frequent value."""
    fd = FDSpec((lhs,), rhs)
    x = counts.x_counts(counts.xy_counts(counts.project(df, [fd])))
    return x.agg(F.coalesce(F.sum(F.col("a") - F.col("m")) / F.sum("a"), F.lit(0.0)).alias("noise"))


def infer_settings(df: DataFrame, lhs: str, rhs: str, noise: bool = False) -> DataFrame:
    """One row: tuples, cardinalities and distributions of both columns, and the noise of lhs -> rhs.

    Rows with a null in either column are left out.
    """
    rows = df.select(lhs, rhs).dropna("any")
    of = lambda c, side: infer_column_settings(rows, c).select(*([F.col("tuples")] if side == "lhs" else []), F.col("cardinality").alias(f"{side}_cardinality"), F.col("dist_alpha").alias(f"{side}_dist_alpha"), F.col("dist_beta").alias(f"{side}_dist_beta"))
    found = of(lhs, "lhs").join(F.broadcast(of(rhs, "rhs")))
    if noise:
        return found.join(F.broadcast(noise_ratio(rows, lhs, rhs)))
    return found.withColumn("noise", F.lit(0.0))


def noise_potential(df: DataFrame, lhs: Sequence[str]) -> DataFrame:
    """(noise_potential): share of rows that can be changed with every group's majority left."""
    sizes = df.groupBy(*lhs).agg(F.count(F.lit(1)).alias("c"))
    return sizes.agg(F.coalesce(F.sum(F.floor(F.col("c") / 2)) / F.sum("c"), F.lit(0.0)).alias("noise_potential"))


def skew_lookup(df_spark, alpha_steps: int = 100, beta_from: int = 10, beta_to: int = 100) -> DataFrame:
    """(alpha, beta, skewness) for alpha in 0.01 .. 1 and beta in 1 .. 10 by 0.1."""
    alpha = df_spark.range(1, alpha_steps + 1).select((F.col("id") / 100.0).alias("alpha"))
    beta = df_spark.range(beta_from, beta_to + 1).select((F.col("id") / 10.0).alias("beta"))
    return alpha.join(F.broadcast(beta)).withColumn("skewness", beta_skewness(F.col("alpha"), F.col("beta")))
