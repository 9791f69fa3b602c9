"""Measures of a dependency as Columns over the totals of ``operators.counts.totals``.

All ratios are guarded: nothing relies on NaN, and ANSI mode never divides by zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Differences of entropies below this are rounding.
TINY = 1e-12


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom)


def c(name: str) -> Column:
    return F.col(name).cast("double")


def pdep_xy() -> Column:
    """Expected probability that two rows with the same X agree on Y."""
    return _ratio(c("sum_c2_a"), c("n"))


def pdep_y() -> Column:
    return _ratio(c("sum_b2"), c("n") * c("n"))


def is_key() -> Column:
    return F.col("n") == F.col("dom_x")


def mu() -> Column:
    """pdep adjusted for chance; 1 for a key, null for a constant Y that is no key."""
    chance = _ratio(1 - pdep_xy(), 1 - pdep_y()) * _ratio(c("n") - 1, c("n") - c("dom_x"))
    return F.when(is_key(), 1.0).otherwise(1 - chance)


def mu_plus() -> Column:
    return F.when(is_key(), 1.0).otherwise(F.greatest(F.lit(0.0), F.coalesce(mu(), F.lit(0.0))))


def lhs_uniqueness() -> Column:
    return F.coalesce(_ratio(c("dom_x"), c("n")), F.lit(0.0))


def h_y() -> Column:
    """Shannon entropy of Y in bits."""
    return F.coalesce(-_ratio(c("sum_b_log_b") - c("rows_y") * F.log2(F.greatest(c("n"), F.lit(1.0))), c("n")), F.lit(0.0)) + 0.0


def h_y_given_x() -> Column:
    return F.coalesce(-_ratio(c("sum_c_log_ca"), c("n")), F.lit(0.0)) + 0.0


def fi() -> Column:
    """Fraction of information; null for a constant Y."""
    return F.when(h_y() > TINY, (h_y() - h_y_given_x()) / h_y())


def bias() -> Column:
    return F.when(h_y() > TINY, c("expected_mi") / h_y())


def rfi() -> Column:
    return fi() - bias()


def rfi_prime_plus() -> Column:
    """Fraction of information above its expectation, scaled by its range above it; 0 if there is none.

    The range is E[H(Y|X)], and H(Y) times the share of rows whose X does not count.
    """
    room = c("expected_h_y_given_x") + F.coalesce(_ratio(c("n") - c("rows_x"), c("n")), F.lit(0.0)) * h_y()
    return F.when(room > TINY, F.greatest(F.lit(0.0), (room - h_y_given_x()) / room)).otherwise(0.0)


def g1() -> Column:
    return 1 - F.coalesce(_ratio(c("violating_pairs"), c("n") * c("n")), F.lit(0.0))


def g2() -> Column:
    return 1 - F.coalesce(_ratio(c("violating_rows"), c("n")), F.lit(0.0))


def g3() -> Column:
    return 1 - F.coalesce(_ratio(c("deletions"), c("n")), F.lit(0.0))


def g3_prime() -> Column:
    left = c("n") - c("dom_x")
    return F.when(left == 0, F.when(F.col("deletions") == 0, 1.0).otherwise(0.0)).otherwise((left - c("deletions")) / left)


#: Measures that need totals only.
COUNT_MEASURES = {"pdep_xy": pdep_xy, "pdep_y": pdep_y, "mu": mu, "mu_plus": mu_plus, "is_key": is_key, "lhs_uniqueness": lhs_uniqueness, "h_y": h_y, "h_y_given_x": h_y_given_x, "fi": fi, "g1": g1, "g2": g2, "g3": g3, "g3_prime": g3_prime}
#: Measures that need the expected mutual information too.
EXPECTATION_MEASURES = {"expected_mi": lambda: c("expected_mi"), "bias": bias, "rfi": rfi, "rfi_prime_plus": rfi_prime_plus}
