"""Scoring dependencies: one plan for one or many, with the measures that are asked for."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depscope.functions.measures import COUNT_MEASURES, EXPECTATION_MEASURES
from depscope.operators import counts, information
from depscope.operators.reliability import ReliabilityConfig, reliability
from depscope.spec import FDSpec

ALL_MEASURES = (*COUNT_MEASURES, *EXPECTATION_MEASURES)


def score(df: DataFrame, fds: FDSpec | Sequence[FDSpec], measures: Iterable[str] = ALL_MEASURES, nulls: str = "group") -> DataFrame:
    """One row per dependency: fd_id, n, dom_x, dom_y, dom_xy and the measures.

    Measures that are not asked for are not computed; without those that need it there is no
    expected mutual information. An empty table gives no rows.
    """
    return score_tables([(df, [fds] if isinstance(fds, FDSpec) else list(fds))], measures, nulls)


def score_tables(tables: Sequence[tuple[DataFrame, Sequence[FDSpec]]], measures: Iterable[str] = ALL_MEASURES, nulls: str = "group") -> DataFrame:
    """``score`` for dependencies of several tables, each table scanned once; fd_ids have to differ.

    Tables meet as totals and as histograms of counts, so that all expectations are one plan.
    """
    measures = list(measures)
    unknown = [m for m in measures if m not in ALL_MEASURES]
    if unknown:
        raise ValueError(f"no measure {', '.join(unknown)}; there are {', '.join(ALL_MEASURES)}")
    totals, histograms, rows = [], [], []
    for df, fds in tables:
        xy = counts.xy_counts_of(df, fds, nulls)
        x, y = counts.x_counts(xy, nulls), counts.y_counts(xy, nulls)
        totals.append(counts.totals(x, y, nulls))
        histograms.append(counts.count_histograms(x, y, nulls))
        rows.append(counts.rows(x))
    total = reduce(DataFrame.unionByName, totals)
    if any(m in EXPECTATION_MEASURES for m in measures):
        # The numbers of rows come from X alone: totals here would put the whole plan of X and Y into the plan once more.
        expected = information.expected_sums(reduce(DataFrame.unionByName, histograms), reduce(DataFrame.unionByName, rows))
        total = total.join(expected, "fd_id", "left").fillna(0.0, information.SUMS)
    build = COUNT_MEASURES | EXPECTATION_MEASURES
    return total.select("fd_id", "n", "dom_x", "dom_y", "dom_xy", *[build[m]().alias(m) for m in measures])


def full_record(df: DataFrame, fd: FDSpec, config: ReliabilityConfig = ReliabilityConfig(), *, nulls: str = "group", given: DataFrame | None = None, id_col: str | None = None) -> DataFrame:
    """Everything about one dependency in one row: its columns, all measures, the reliability record."""
    measures = score(df, fd, nulls=nulls)
    judged = reliability(df, fd, config, given=given, id_col=id_col)
    names = [F.array(*map(F.lit, fd.lhs)).alias("lhs"), F.lit(fd.rhs).alias("rhs"), F.lit(len(fd.lhs)).alias("lhs_size")]
    return measures.join(judged, "fd_id").select("fd_id", *names, *[c for c in measures.columns if c != "fd_id"], *[c for c in judged.columns if c != "fd_id"])


def unary_candidates(df: DataFrame, columns: Sequence[str] | None = None) -> list[FDSpec]:
    """All dependencies between two different columns of ``df``."""
    columns = list(columns or df.columns)
    return [FDSpec((a,), b) for a in columns for b in columns if a != b]


def ranked_report(df: DataFrame, columns: Sequence[str] | None = None, measures: Iterable[str] = tuple(COUNT_MEASURES), by: str = "mu_plus", nulls: str = "group") -> DataFrame:
    """All unary candidates of a table in one scan, with their rank by a measure (ties by name)."""
    from pyspark.sql import Window

    scored = score(df, unary_candidates(df, columns), {*measures, by}, nulls)
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), "fd_id")))
