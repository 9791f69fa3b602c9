"""Reliability of a dependency: violations, independence test, stability, verdict.

The violations' values in every column outside the dependency are compared with those of the
other rows (chi-square, present values only). If some column tells them apart, the violations
have a cause and the dependency is rejected. Otherwise the stability score tells how much of the
majority agreement a random assignment would also give; lower is better.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depscope.functions.special import chi2_sf
from depscope.operators import counts
from depscope.operators.violations import flag_violations, given_violations, violation_totals
from depscope.spec import FDSpec


@dataclass(frozen=True)
class ReliabilityConfig:
    """dirty_data: violations are found by majority; otherwise they are given."""

    dirty_data: bool = True
    use_independence_test: bool = True
    significance: float = 1e-4
    violation_rate_threshold: float = 0.5
    stability_threshold: float = 0.5

    @classmethod
    def clean(cls, **changes) -> ReliabilityConfig:
        return cls(**({"dirty_data": False, "use_independence_test": False} | changes))


def chi_square(flagged: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(ordinal, column, stat, df, p_value) of is_violation against each column, in the order given.

    Null cells are skipped. A column with fewer than two values, or only violations or none
    among its cells, has statistic 0 and p 1. Values are combined before they are shuffled and
    summed up where they are; only one row per column is left.
    """
    schema = "ordinal int, column string, stat double, df long, p_value double"
    if not columns:
        return flagged.sparkSession.createDataFrame([], schema)
    cells = [F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(columns)]
    long = flagged.select("is_violation", F.explode(F.array(*cells)).alias("cell")).select("is_violation", "cell.*")
    v = F.col("is_violation").cast("long")
    present = F.col("value").isNotNull()
    values = long.groupBy("ordinal", "column", "value").agg(F.sum(v).alias("v"), F.sum(1 - v).alias("h"))
    h, viol = F.col("h").cast("double"), F.col("v").cast("double")
    t = h + viol
    sums = values.groupBy("ordinal", "column").agg(
        F.count(F.when(present, 1)).alias("values"),
        F.coalesce(F.sum(F.when(present, h)), F.lit(0.0)).alias("sum_h"),
        F.coalesce(F.sum(F.when(present, viol)), F.lit(0.0)).alias("sum_v"),
        F.coalesce(F.sum(F.when(present, h * h / t)), F.lit(0.0)).alias("hh"),
        F.coalesce(F.sum(F.when(present, viol * viol / t)), F.lit(0.0)).alias("vv"),
    )
    testable = (F.col("values") >= 2) & (F.col("sum_h") > 0) & (F.col("sum_v") > 0)
    total = F.col("sum_h") + F.col("sum_v")
    # sum of (observed - expected)^2 / expected over both rows of the table.
    stat = F.greatest(F.lit(0.0), total * (F.col("hh") / F.col("sum_h") + F.col("vv") / F.col("sum_v") - 1))
    stat = F.when(testable, stat).otherwise(0.0)
    out = sums.select("ordinal", "column", stat.alias("stat"), F.greatest(F.col("values") - 1, F.lit(0)).alias("df"), testable.alias("testable"))
    return out.select("ordinal", "column", "stat", "df", F.when(F.col("testable"), chi2_sf(F.col("stat"), F.col("df"))).otherwise(1.0).alias("p_value"))


def _score(groups: DataFrame) -> DataFrame:
    """score from (y, m): the value and the count that stand for each group."""
    by_value = groups.groupBy("y").agg(F.sum("m").alias("f"), F.sum(F.when(F.col("m") > 1, F.col("m")).otherwise(0)).alias("stable"))
    total = by_value.agg(F.sum("f").alias("total"))
    f, lv = F.col("f").cast("double"), F.col("total").cast("double")
    part = F.when(F.col("total") > 0, (1 - f / lv) * F.col("stable") / lv)
    return by_value.join(F.broadcast(total)).agg((1 - F.coalesce(F.sum(part), F.lit(0.0))).alias("score"))


def stability_by_majority(df: DataFrame, fd: FDSpec) -> DataFrame:
    """(score) with each group standing for its majority over all rows."""
    x = counts.x_counts(counts.xy_counts(counts.project(df, [fd])))
    x = x.filter(~counts.x_is_null(x) & F.col("majority").isNotNull())
    return _score(x.select(F.col("majority.y").alias("y"), F.col("majority.c").alias("m")))


def stability_by_first_value(flagged: DataFrame, fd: FDSpec, id_col: str) -> DataFrame:
    """(score) over the rows that are no violations, each group standing for the value of its first row by id."""
    rows = counts.project(flagged.filter(~F.col("is_violation")), [fd], carry=[id_col])
    rows = rows.filter(~counts.x_is_null(rows) & F.col("y").isNotNull())
    xy = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"), F.min(id_col).alias("first"))
    first = xy.groupBy("x").agg(F.min_by(F.struct("y", "c"), "first").alias("g"))
    return _score(first.select("g.y", F.col("g.c").alias("m")))


def reliability(df: DataFrame, fd: FDSpec, config: ReliabilityConfig = ReliabilityConfig(), *, given: DataFrame | None = None, id_col: str | None = None) -> DataFrame:
    """One row: fd_id, ar_score, ar_violation_count, ar_violation_rate, ar_is_reliable, indep_used, indep_rejected, indep_pvalue, ar_score_fused.

    Clean mode needs ``given`` (row_id) and ``id_col``. The reported p-value is that of the first
    column, in the table's order, that rejects, else of the last one tested; -1 where the rate
    alone rejects; null where no test is made.
    """
    fd.check(df)
    if config.dirty_data:
        flagged = flag_violations(df, fd)
        total = violation_totals(df, fd)
        score = stability_by_majority(df, fd).select(F.col("score"), F.col("score").alias("fused"))
    else:
        if given is None or id_col is None:
            raise ValueError("clean mode needs the given violations and the column of row ids")
        flagged = given_violations(df, given, id_col)
        fused = stability_by_majority(df, fd).select(F.col("score").alias("fused"))
        score = stability_by_first_value(flagged, fd, id_col).join(F.broadcast(fused))
        total = flagged.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("is_violation").cast("long")), F.lit(0)).alias("violations"))
    rate = F.when(F.col("n") > 0, F.col("violations") / F.col("n")).otherwise(0.0)
    out = total.join(F.broadcast(score))
    if config.use_independence_test:
        others = [c for c in df.columns if c not in (*fd.lhs, fd.rhs, id_col)]
        tests = chi_square(flagged, others)
        hit = F.when(F.col("p_value") < config.significance, F.col("ordinal"))
        chosen = tests.agg(F.min_by("p_value", hit).alias("first_p"), F.max_by("p_value", "ordinal").alias("last_p"))
        out = out.join(F.broadcast(chosen))
    else:
        out = out.withColumns({"first_p": F.lit(None).cast("double"), "last_p": F.lit(None).cast("double")})
    used: Column = F.lit(config.use_independence_test) & (F.col("violations") > 0)
    by_rate = used & (rate > config.violation_rate_threshold)
    rejected = by_rate | (used & F.col("first_p").isNotNull())
    p = F.when(by_rate, -1.0).when(used, F.coalesce("first_p", "last_p"))
    final = F.when(rejected, 1.0).otherwise(F.col("score"))
    return out.select(
        F.lit(fd.fd_id).alias("fd_id"),
        final.alias("ar_score"),
        F.col("violations").alias("ar_violation_count"),
        rate.alias("ar_violation_rate"),
        (~rejected & (final <= config.stability_threshold)).alias("ar_is_reliable"),
        used.alias("indep_used"),
        rejected.alias("indep_rejected"),
        p.alias("indep_pvalue"),
        F.col("fused").alias("ar_score_fused"),
    )
