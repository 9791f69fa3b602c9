"""Majorities and the rows that deviate from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depscope.operators import counts
from depscope.spec import FDSpec


def _groups(df: DataFrame, fd: FDSpec) -> DataFrame:
    return counts.x_counts(counts.xy_counts(counts.project(df, [fd])))


def majorities(df: DataFrame, fd: FDSpec) -> DataFrame:
    """(x, majority_y, majority_count) for every X without null that has a non-null Y.

    The majority is the most frequent Y, on a tie the one whose text comes first by bytes.
    """
    x = _groups(df, fd)
    x = x.filter(~counts.x_is_null(x) & F.col("majority").isNotNull())
    return x.select("x", F.col("majority.y").alias("majority_y"), F.col("majority.c").alias("majority_count"))


def violation_totals(df: DataFrame, fd: FDSpec) -> DataFrame:
    """One row (n, violations): rows and those that ``flag_violations`` would mark, from the groups alone."""
    fd.check(df)
    # Counts alone: m is the majority's count, and without texts in the state groups are hashed, not sorted.
    x = counts.x_counts(counts.xy_counts(counts.project(df, [fd])), "drop")
    own = F.when(~counts.x_is_null(x) & (F.col("m") > 0), F.col("a") - F.col("m"))
    return x.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n"), F.coalesce(F.sum(own), F.lit(0)).alias("violations"))


def flag_violations(df: DataFrame, fd: FDSpec, *, hot_groups: int = 1000) -> DataFrame:
    """``df`` with the column is_violation.

    A row violates the dependency if its X has no null, its group has a majority, and its Y is
    another value or null. Groups with one row in ``hot_groups`` or more, of which there are at most
    ``hot_groups``, are broadcast: their rows, and those with a null in X, stay where they are. Only rows of
    other groups are shuffled by X, so that no task gets a large group.
    """
    fd.check(df)
    x = F.struct(*[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(fd.lhs)])
    x_null = F.lit(False)
    for c in fd.lhs:
        x_null = x_null | F.col(f"`{c}`").isNull()
    groups = _groups(df, fd)
    groups = groups.filter(~counts.x_is_null(groups) & F.col("majority").isNotNull())
    groups = groups.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))))
    groups = groups.select(F.col("x").alias("__x"), F.col("majority.y").alias("__majority"), (F.col("a") * hot_groups >= F.col("total")).alias("__is_hot"))
    keep = [f"`{c}`" for c in df.columns if c != "is_violation"]
    rows = df.select(*keep, F.when(~x_null, x).alias("__own"), F.col(f"`{fd.rhs}`").cast("string").alias("__y"))
    hot = groups.filter("__is_hot").select("__x", "__majority")
    near = rows.join(F.broadcast(hot), F.col("__own") == F.col("__x"), "left")
    settled = near.filter(F.col("__x").isNotNull() | F.col("__own").isNull())
    others = near.filter(F.col("__x").isNull() & F.col("__own").isNotNull()).select(*keep, "__own", "__y")
    others = others.join(groups.filter("not __is_hot").select("__x", "__majority"), F.col("__own") == F.col("__x"), "left")
    violates = F.col("__majority").isNotNull() & ~F.col("__y").eqNullSafe(F.col("__majority"))
    return settled.unionByName(others).select(*keep, violates.alias("is_violation"))


def given_violations(df: DataFrame, row_ids: DataFrame, id_col: str) -> DataFrame:
    """``df`` with is_violation for the rows whose id is in ``row_ids`` (column row_id); repeated ids count once."""
    marked = row_ids.select(F.col("row_id").alias("__row_id")).distinct().withColumn("__mark", F.lit(True))
    joined = df.drop("is_violation").join(marked, F.col(id_col) == F.col("__row_id"), "left")
    return joined.withColumn("is_violation", F.coalesce("__mark", F.lit(False))).drop("__row_id", "__mark")
