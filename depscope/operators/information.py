"""Expected mutual information of X and Y under random pairing (the permutation model).

E[MI] is a sum over pairs of a count a of X and a count b of Y. Only the histograms of counts matter:
pairs of different counts, weighted by how many values have them. For a pair, k rows in common
are hypergeometric, and each probability is taken in log space, so nothing underflows however
large the groups are: as remainders of Stirling's formula and deviances from the mean, which are
small where log factorials are as large as n log n and leave their rounding. Terms farther than 40 standard deviations from the mean are below any
rounding and left out; where even those within are more than ``most_terms``, the moments of k
give the sum by a Taylor series, whose relative error is of the order of the mean's inverse.

The same terms give E[H(Y|X)], which is what H(Y) has above E[MI]: exactly 0 where every X is
unique, and without the rounding of a difference where nearly every X is.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depscope.functions.special import deviance, factorial_rest

#: Terms of a pair are summed in pieces of so many, as rows of their own.
PIECE = 4096
#: Shares of one dependency's pairs.
SHARES = 64
#: Columns of ``expected_sums``.
SUMS = ["expected_mi", "expected_h_y_given_x"]


def expected_mi(hist: DataFrame, n: DataFrame, *, most_terms: int = 4_000_000) -> DataFrame:
    """(fd_id, expected_mi, expected_h_y_given_x) in bits from ``count_histograms`` and (fd_id, n)."""
    return n.select("fd_id").join(expected_sums(hist, n, most_terms=most_terms), "fd_id", "left").fillna(0.0, SUMS)


def expected_sums(hist: DataFrame, n: DataFrame, *, most_terms: int = 4_000_000) -> DataFrame:
    """``expected_mi`` without the rows of dependencies that have no pair of counts."""
    hx = hist.filter("side = 'x'").select("fd_id", F.col("count").alias("a"), F.col("weight").alias("wa"))
    hy = hist.filter("side = 'y'").select("fd_id", F.col("count").alias("b"), F.col("weight").alias("wb"))
    # Histograms are few bytes and their pairs many rows: counts of X are dealt to a number of tasks that is not reduced
    # for lack of bytes, and those of Y go to every share of their dependency.
    tasks = int(hist.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = min(tasks, SHARES)
    hx = hx.withColumn("share", F.pmod(F.xxhash64("a"), F.lit(shares)).cast("int")).repartition(tasks, "fd_id", "share")
    hy = hy.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartition(tasks, "fd_id", "share")
    pairs = hx.join(hy, ["fd_id", "share"]).join(F.broadcast(n.select("fd_id", "n")), "fd_id")
    a, b, rows = (F.col(x).cast("double") for x in ("a", "b", "n"))
    mean = a * b / rows
    sd = F.sqrt(mean * (1 - a / rows) * (1 - b / rows) * rows / F.greatest(rows - 1, F.lit(1.0)))
    lo = F.greatest(F.lit(1).cast("long"), F.col("a") + F.col("b") - F.col("n"), F.floor(mean - 40 * sd - 40))
    hi = F.least(F.col("a"), F.col("b"), F.ceil(mean + 40 * sd + 40))
    pairs = pairs.select("fd_id", "n", "a", "b", (F.col("wa") * F.col("wb")).cast("double").alias("w"), lo.alias("lo"), hi.alias("hi"), mean.alias("mean"), sd.alias("sd")).filter("hi >= lo")
    # Pairs that take the series are a single row; as a union their plan would hold the counts of all tables twice.
    few = F.col("hi") - F.col("lo") < most_terms
    pieces = pairs.withColumn("from", F.explode(F.when(few, F.sequence("lo", "hi", F.lit(PIECE).cast("long"))).otherwise(F.array("lo"))))
    # Few bytes, much work: dealt evenly, to a number of tasks that is not reduced for lack of bytes.
    pieces = pieces.repartition(tasks, "fd_id", "a", "b", "from")
    fixed = factorial_rest(F.col("a")) + factorial_rest(F.col("b")) + factorial_rest(F.col("n") - F.col("a")) + factorial_rest(F.col("n") - F.col("b")) - factorial_rest(F.col("n"))
    terms = pieces.withColumn("fixed", fixed).withColumn("k", F.explode(F.when(few, F.sequence("from", F.least(F.col("hi"), F.col("from") + PIECE - 1))).otherwise(F.array("from"))))
    k = F.col("k").cast("double")
    off = k - F.col("mean")
    # The four cells: what they hold, what is expected, how far they are off.
    cells = [(F.col("k"), F.col("mean"), off), (F.col("a") - F.col("k"), a * (rows - b) / rows, -off), (F.col("b") - F.col("k"), (rows - a) * b / rows, -off), (F.col("n") - F.col("a") - F.col("b") + F.col("k"), (rows - a) * (rows - b) / rows, off)]
    log_p = F.col("fixed")
    for cell, expected, difference in cells:
        log_p = log_p - factorial_rest(cell) - deviance(cell.cast("double"), expected, difference)
    terms = terms.withColumn("share", F.exp(log_p) * k / rows)
    # f(k) = k/n log2(k/mean): f(mean) = 0, f'' = 1/(n k ln 2), f''' = -1/(n k^2 ln 2), f'''' = 2/(n k^3 ln 2).
    var = F.col("sd") * F.col("sd")
    third = var * (1 - 2 * a / rows) * (1 - 2 * b / rows)
    series = (var / 2 / F.col("mean") - third / 6 / F.pow("mean", F.lit(2)) + 2 * 3 * var * var / 24 / F.pow("mean", F.lit(3))) / (rows * math.log(2))
    part = F.when(few, F.col("share") * F.log2(k / F.col("mean"))).otherwise(series)
    left = F.when(few, F.col("share") * F.log2(a / k)).otherwise(F.col("mean") / rows * F.log2(rows / b) - series)
    return terms.groupBy("fd_id").agg(F.sum(F.col("w") * part).alias("expected_mi"), F.sum(F.col("w") * left).alias("expected_h_y_given_x"))
