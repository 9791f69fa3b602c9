"""Dependency counts over a stream.

The state is one count per (x, y): groupBy over the stream, in update or complete mode. Scores are
taken of the state, not of rows, so each trigger costs its changed groups; late rows are as
good as early ones, and no watermark is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depscope.functions.measures import COUNT_MEASURES
from depscope.operators import counts
from depscope.spec import FDSpec


def stream_counts(stream: DataFrame, fds: Sequence[FDSpec], nulls: str = "group") -> DataFrame:
    """Streaming (fd_id, x, y, c)."""
    return counts.xy_counts(counts.project(stream, fds, nulls))


def windowed_counts(stream: DataFrame, fds: Sequence[FDSpec], time_col: str, width: str, delay: str) -> DataFrame:
    """Streaming (window, fd_id, x, y, c) by tumbling windows of event time; windows close ``delay`` after their end."""
    rows = counts.project(stream.withWatermark(time_col, delay), fds, carry=[time_col])
    return rows.groupBy(F.window(time_col, width), "fd_id", "x", "y").agg(F.count(F.lit(1)).alias("c"))


def score_state(xy: DataFrame, measures: Sequence[str] = tuple(COUNT_MEASURES), nulls: str = "group") -> DataFrame:
    """Measures of each dependency from its counts."""
    total = counts.totals(counts.x_counts(xy, nulls), counts.y_counts(xy, nulls), nulls)
    return total.select("fd_id", "n", *[COUNT_MEASURES[m]().alias(m) for m in measures])


def score_stream(stream: DataFrame, fds: Sequence[FDSpec], sink: Callable[[DataFrame, int], None], checkpoint: str, measures: Sequence[str] = tuple(COUNT_MEASURES)):
    """Start a query that hands the scores so far to ``sink`` (frame, number) after each trigger."""
    writer = stream_counts(stream, fds).writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(lambda state, number: sink(score_state(state, measures), number)).start()
