"""Counts behind every measure: rows -> (X, Y) -> X and Y -> totals.

Rows are grouped once. The tables of X and of Y are roll-ups of the (X, Y) table, which is at most as
large and usually far smaller, and both read the same shuffle. No join and no window is
needed: whatever the measures want from "c next to its a" is a sum over c times a function
of a, so the X roll-up carries sum(c^2) and sum(c log c). Each step combines before it shuffles,
so a hot X costs one row a task.

One dependency keeps its column types (X is a struct). Many dependencies over one table are counted in
one scan by grouping sets, one for each set of columns, so that a -> b and b -> a share theirs;
only the groups are then turned into texts (X is an array of them) and handed to their dependencies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depscope.spec import FDSpec

#: "group": null is a value like any other. "drop": rows with a null count in n and in the number of
#: X only; NaN is null too.
NULL_MODES = ("group", "drop")


def _value(df: DataFrame, name: str, nulls: str) -> Column:
    col = F.col(f"`{name}`")
    if nulls == "drop" and isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col), col)
    return col


def project(df: DataFrame, fds: Sequence[FDSpec], nulls: str = "group", carry: Sequence[str] = ()) -> DataFrame:
    """(fd_id, x, y) for every row and dependency, and the columns ``carry``."""
    if nulls not in NULL_MODES:
        raise ValueError(f"nulls must be one of {NULL_MODES}")
    for fd in fds:
        fd.check(df)
    if len(fds) == 1:
        fd = fds[0]
        x = F.struct(*[_value(df, c, nulls).alias(f"x{i}") for i, c in enumerate(fd.lhs)])
        return df.select(F.lit(fd.fd_id).alias("fd_id"), x.alias("x"), _value(df, fd.rhs, nulls).alias("y"), *carry)
    text = lambda c: _value(df, c, nulls).cast("string")
    each = [F.struct(F.lit(fd.fd_id).alias("fd_id"), F.array(*[text(c) for c in fd.lhs]).alias("x"), text(fd.rhs).alias("y")) for fd in fds]
    return df.select(F.explode(F.array(*each)).alias("fd"), *carry).select("fd.fd_id", "fd.x", "fd.y", *carry)


def x_is_null(df: DataFrame) -> Column:
    """Whether a component of x is null."""
    kind = df.schema["x"].dataType
    if isinstance(kind, T.ArrayType):
        return F.exists("x", lambda v: v.isNull())
    out = F.lit(False)
    for field in kind.fields:
        out = out | F.col(f"x.{field.name}").isNull()
    return out


def xy_counts(rows: DataFrame) -> DataFrame:
    """(fd_id, x, y, c) from projected rows."""
    return rows.groupBy("fd_id", "x", "y").agg(F.count(F.lit(1)).alias("c"))


def xy_counts_of(df: DataFrame, fds: Sequence[FDSpec], nulls: str = "group") -> DataFrame:
    """(fd_id, x, y, c) of all dependencies of a table."""
    if len(fds) == 1:
        return xy_counts(project(df, fds, nulls))
    if nulls not in NULL_MODES:
        raise ValueError(f"nulls must be one of {NULL_MODES}")
    for fd in fds:
        fd.check(df)
    columns = [c for c in df.columns if any(c in (*fd.lhs, fd.rhs) for fd in fds)]
    typed = df.select(*[_value(df, c, nulls).alias(f"k{i}") for i, c in enumerate(columns)])
    at = {c: i for i, c in enumerate(columns)}
    sets: dict[frozenset[int], list[FDSpec]] = {}
    for fd in fds:
        sets.setdefault(frozenset(at[c] for c in (*fd.lhs, fd.rhs)), []).append(fd)
    keys = [F.col(f"k{i}") for i in range(len(columns))]
    groups = typed.groupingSets([[keys[i] for i in sorted(s)] for s in sets], *keys).agg(F.count(F.lit(1)).alias("c"), F.grouping_id().alias("gid"))
    # The bits of grouping_id are set for columns that a set leaves out, the first column highest.
    gid = lambda s: sum(1 << (len(columns) - 1 - i) for i in range(len(columns)) if i not in s)
    text = lambda c: keys[at[c]].cast("string")
    mine = None
    for s, own in sets.items():
        each = F.array(*[F.struct(F.lit(fd.fd_id).alias("fd_id"), F.array(*[text(c) for c in fd.lhs]).alias("x"), text(fd.rhs).alias("y")) for fd in own])
        here = F.col("gid") == F.lit(gid(s))
        mine = F.when(here, each) if mine is None else mine.when(here, each)
    return groups.select(F.explode(mine).alias("fd"), "c").select("fd.fd_id", "fd.x", "fd.y", "c")


def x_counts(xy: DataFrame, nulls: str = "group") -> DataFrame:
    """One row per (fd_id, x).

    a: rows; a_y: rows with a counted y; k: different y; m: largest c; c2: sum of c^2; c_log_c; majority:
    struct(c, y) of the most frequent non-null y, the smallest text on a tie.
    """
    c = F.col("c").cast("double")
    valid = F.lit(True) if nulls == "group" else F.col("y").isNotNull()
    y = F.col("y").cast("string")
    first = F.min(F.when(F.col("y").isNotNull(), F.struct((-F.col("c")).alias("minus_c"), y.alias("y"))))
    out = xy.groupBy("fd_id", "x").agg(
        F.sum("c").alias("a"),
        F.coalesce(F.sum(F.when(valid, F.col("c"))), F.lit(0)).alias("a_y"),
        F.count(F.when(valid, 1)).alias("k"),
        F.coalesce(F.max(F.when(valid, F.col("c"))), F.lit(0)).alias("m"),
        F.coalesce(F.sum(F.when(valid, c * c)), F.lit(0.0)).alias("c2"),
        F.coalesce(F.sum(F.when(valid, c * F.log2(c))), F.lit(0.0)).alias("c_log_c"),
        first.alias("first"),
    )
    majority = F.when(F.col("first").isNotNull(), F.struct((-F.col("first.minus_c")).alias("c"), F.col("first.y").alias("y")))
    return out.withColumn("majority", majority).drop("first")


def y_counts(xy: DataFrame, nulls: str = "group") -> DataFrame:
    """(fd_id, y, b)."""
    xy = xy if nulls == "group" else xy.filter(F.col("y").isNotNull())
    return xy.groupBy("fd_id", "y").agg(F.sum("c").alias("b"))


def count_histograms(x: DataFrame, y: DataFrame, nulls: str = "group") -> DataFrame:
    """(fd_id, side, count, weight): how many values of X, and of Y, have each count."""
    if nulls == "drop":
        x = x.filter(~x_is_null(x))
    sides = x.select("fd_id", F.lit("x").alias("side"), F.col("a").alias("count")).unionByName(y.select("fd_id", F.lit("y").alias("side"), F.col("b").alias("count")))
    return sides.groupBy("fd_id", "side", "count").agg(F.count(F.lit(1)).alias("weight"))


def rows(x: DataFrame) -> DataFrame:
    """(fd_id, n)."""
    return x.groupBy("fd_id").agg(F.sum("a").alias("n"))


def totals(x: DataFrame, y: DataFrame, nulls: str = "group") -> DataFrame:
    """One row per dependency with the sums that measures are made of."""
    a, a_y = F.col("a").cast("double"), F.col("a_y").cast("double")
    counted = F.lit(True) if nulls == "group" else ~x_is_null(x)
    whole = (F.col("k") == 1) & (F.col("a") == F.col("m"))

    def sum_of(value: Column, zero) -> Column:
        return F.coalesce(F.sum(F.when(counted, value)), F.lit(zero))

    of_x = x.groupBy("fd_id").agg(
        F.sum("a").alias("n"),
        F.count(F.lit(1)).alias("dom_x"),
        sum_of(F.col("a"), 0).alias("rows_x"),
        sum_of(F.col("k"), 0).alias("dom_xy"),
        sum_of(F.col("c2") / a, 0.0).alias("sum_c2_a"),
        sum_of(F.col("c_log_c") - a_y * F.log2(a), 0.0).alias("sum_c_log_ca"),
        sum_of(a * a_y - F.col("c2"), 0.0).alias("violating_pairs"),
        sum_of(F.when(whole, 0).otherwise(F.col("a_y")), 0).alias("violating_rows"),
        sum_of(F.col("a_y") - F.col("m"), 0).alias("deletions"),
    )
    b = F.col("b").cast("double")
    of_y = y.groupBy("fd_id").agg(F.count(F.lit(1)).alias("dom_y"), F.sum("b").alias("rows_y"), F.sum(b * b).alias("sum_b2"), F.sum(b * F.log2(b)).alias("sum_b_log_b"))
    out = of_x.join(of_y, "fd_id", "left")
    return out.fillna(0, ["dom_y", "rows_y", "sum_b2", "sum_b_log_b"])
