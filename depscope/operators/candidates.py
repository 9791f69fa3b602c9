"""Candidates with ground truth, and which of them take part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Negative samples with a larger share of violations are left out.
VIOLATION_THRESHOLD = 0.05


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def filter_candidates(candidates: DataFrame, rows: int, numeric: list[str], threshold: float = VIOLATION_THRESHOLD) -> DataFrame:
    """Candidates (left_col, right_col, sample_type, violation_rows as an array) that take part.

    Those with sample_type N do not if their violations exceed ``threshold`` of the rows or both
    columns are numeric. A null list counts as empty.
    """
    rate = F.coalesce(F.size("violation_rows"), F.lit(0)) / F.lit(max(rows, 1))
    both = F.col("left_col").isin(*numeric) & F.col("right_col").isin(*numeric) if numeric else F.lit(False)
    drop = F.coalesce(F.col("sample_type") == "N", F.lit(False)) & ((rate > threshold) | F.coalesce(both, F.lit(False)))
    return candidates.filter(~drop)
