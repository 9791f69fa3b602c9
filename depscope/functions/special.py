"""Special functions as Column expressions, so that they stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)


def lgamma(x: Column) -> Column:
    """ln gamma(x) for x > 0: Stirling's series at x + 8, taken back by the recurrence.

    Absolute error about 1e-12 up to x = 1000, then relative rounding.
    """
    x = x.cast("double")
    y = x + 8.0
    product = x
    for i in range(1, 8):
        product = product * (x + float(i))
    y2 = y * y
    series = (F.lit(1 / 12) - (F.lit(1 / 360) - (F.lit(1 / 1260) - F.lit(1 / 1680) / y2) / y2) / y2) / y
    return (y - 0.5) * F.log(y) - y + F.lit(_HALF_LOG_2PI) + series - F.log(product)


#: ln m! - (m ln m - m) for m below 16, where the series is not exact.
_REST = [0.0, *[math.log(math.factorial(m)) - m * math.log(m) + m for m in range(1, 16)]]


def factorial_rest(m: Column) -> Column:
    """ln m! - (m ln m - m) for whole m >= 0: what Stirling's main term leaves, no larger than a few logarithms."""
    m = m.cast("double")
    big = F.greatest(m, F.lit(16.0))
    m2 = big * big
    series = (F.lit(1 / 12) - (F.lit(1 / 360) - (F.lit(1 / 1260) - F.lit(1 / 1680) / m2) / m2) / m2) / big
    return F.when(m < 16, F.get(F.array(*map(F.lit, _REST)), m.cast("int"))).otherwise(0.5 * F.log(big) + F.lit(_HALF_LOG_2PI) + series)


def deviance(count: Column, expected: Column, difference: Column) -> Column:
    """count ln(count / expected) - difference, where difference = count - expected, without cancellation; 0 if nothing is expected."""
    some = F.when(expected > 0, expected).otherwise(1.0)
    r = difference / some
    near = some * ((1 + r) * F.log1p(r) - r)
    far = count * F.log(F.greatest(count, F.lit(1.0)) / some) - difference
    return F.when(expected <= 0, 0.0).when(F.abs(r) < 0.5, near).otherwise(far)


def chi2_sf(stat: Column, df: Column) -> Column:
    """P(chi-square with df degrees of freedom >= stat).

    One minus the series of the lower incomplete gamma function, whose terms are summed in
    log space; absolute error about 1e-10. Far in the tail (beyond mean + 40 standard
    deviations + 1600) it is 0.
    """
    a, x = df.cast("double") / 2, stat.cast("double") / 2
    far = x > a + 40 * F.sqrt(a) + 800
    terms = F.when(far | (x <= 0), F.lit(0)).otherwise(F.ceil(F.greatest(x - a, F.lit(0.0)) + 12 * F.sqrt(x + a) + 60)).cast("int")
    first = a * F.log(F.greatest(x, F.lit(1e-300))) - x
    step = F.log(F.greatest(x, F.lit(1e-300)))
    lower = F.aggregate(F.sequence(F.lit(0), terms), F.lit(0.0), lambda s, i: s + F.exp(first + i.cast("double") * step - lgamma(a + i.cast("double") + 1)))
    p = F.when(df <= 0, 1.0).when(x <= 0, 1.0).when(far, 0.0).otherwise(1 - lower)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def beta_skewness(alpha: Column, beta: Column) -> Column:
    """Skewness of the beta distribution."""
    return 2 * (beta - alpha) * F.sqrt(alpha + beta + 1) / ((alpha + beta + 2) * F.sqrt(alpha * beta))
