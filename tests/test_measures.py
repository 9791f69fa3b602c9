"""Measures against values computed independently from the formulas, and their invariants."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from depscope.functions.special import chi2_sf, factorial_rest, lgamma
from depscope.operators import counts, information
from depscope.plans.score import ALL_MEASURES, ranked_report, score, unary_candidates
from depscope.spec import FDSpec

FD = FDSpec(("x",), "y")
F1 = ["a1", "a1", "a2", "b2", "b2", "c3"]
F2 = ["a1"] * 5 + ["a2"] + ["b2"] * 4 + ["c1"] * 3 + ["c3"]
F3 = ["a1", "b2", "c2"]
F4 = ["a1", "a1", "b1"]
GOLDEN = {
    "pdep_xy": (0.777777778, 0.773809524, 1, 1),
    "pdep_y": (0.388888889, 0.459183673, 0.555555556, 1),
    "mu_plus": (0.393939394, 0.505717553, 1, 0),
    "h_y": (1.459147917, 1.263809174, 0.918295834, 0),
    "h_y_given_x": (0.459147917, 0.510374788, 0, 0),
    "fi": (0.685331479, 0.596161511, 1, None),
    "expected_mi": (0.678512951, 0.251697887, 0.918295834, 0),
    "bias": (0.465006284, 0.199158142, 1, None),
    "rfi_prime_plus": (0.411827631, 0.495732540, 0, 0),
    "g1": (0.888888889, 0.918367347, 1, 1),
    "g2": (0.5, 0.285714286, 1, 1),
    "g3": (0.833333333, 0.857142857, 1, 1),
    "g3_prime": (0.666666667, 0.818181818, 1, 1),
}


def frame(spark, rows):
    return spark.createDataFrame([(r[0], r[1:]) for r in rows], "x string, y string")


@pytest.mark.parametrize("i,rows", list(enumerate((F1, F2, F3, F4))))
def test_golden(spark, i, rows):
    got = score(frame(spark, rows), FD).first()
    for name, values in GOLDEN.items():
        want = values[i]
        assert got[name] is None if want is None else got[name] == pytest.approx(want, abs=1e-8), name


def brute(rows):
    from collections import Counter

    n, xy = len(rows), Counter(rows)
    x, y = Counter(r[0] for r in rows), Counter(r[1] for r in rows)
    best = {k: max(c for (a, _), c in xy.items() if a == k) for k in x}

    def pair(a, b):
        total = 0.0
        for k in range(max(1, a + b - n), min(a, b) + 1):
            p = math.comb(a, k) * math.comb(n - a, b - k) / math.comb(n, b)
            total += p * k / n * math.log2(k * n / (a * b))
        return total

    return {
        "pdep_xy": sum(c * c / x[a] for (a, _), c in xy.items()) / n,
        "h_y_given_x": -sum(c / n * math.log2(c / x[a]) for (a, _), c in xy.items()),
        "g1": 1 - sum(c * (x[a] - c) for (a, _), c in xy.items()) / n**2,
        "g2": 1 - sum(c for (a, _), c in xy.items() if c < x[a]) / n,
        "g3": 1 - sum(x[a] - best[a] for a in x) / n,
        "expected_mi": sum(pair(a, b) for a in x.values() for b in y.values()),
    }


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from("uvw")), min_size=1, max_size=40), st.randoms())
def test_brute_force_and_invariants(spark, rows, rnd):
    df = spark.createDataFrame(rows, "x string, y string")
    got = score(df, FD).first().asDict()
    for name, want in brute(rows).items():
        assert got[name] == pytest.approx(want, abs=1e-8), name
    assert 0 <= got["mu_plus"] <= 1 and 0 <= got["rfi_prime_plus"] <= 1
    assert got["g2"] <= got["g3"] + 1e-12 and got["expected_mi"] <= got["h_y"] + 1e-9
    again = list(rows)
    rnd.shuffle(again)
    other = spark.createDataFrame([(x, {"u": "9", "v": "8", "w": "7"}[y]) for x, y in again], "x string, y string")
    moved = score(other, FD).first().asDict()
    for m in ALL_MEASURES:
        assert (got[m] is None) == (moved[m] is None)
        assert got[m] is None or got[m] == pytest.approx(moved[m], abs=1e-9)


def test_exact_dependency(spark):
    df = spark.range(60).select((F.col("id") % 7).alias("x"), (F.col("id") % 7 % 3).alias("y"))
    got = score(df, FD).first()
    assert got["g1"] == got["g2"] == got["g3"] == got["g3_prime"] == 1 and got["h_y_given_x"] == 0


def test_null_modes(spark):
    df = spark.createDataFrame([(None, "u"), (None, "v"), ("k", "u"), ("k", None)], "x string, y string")
    for mode, n, d in (("group", 4, 2), ("drop", 4, 2)):
        got = score(df, FD, nulls=mode).first()
        assert (got["n"], got["dom_x"]) == (n, d)
    assert score(df, FD, ["pdep_xy"], "group").first()["pdep_xy"] == pytest.approx(0.5)
    # Rows (k, u) only: 1^2 / 2 rows of k / 4 rows.
    assert score(df, FD, ["pdep_xy"], "drop").first()["pdep_xy"] == pytest.approx(0.125)
    assert score(df, FD, ["g3"], "drop").first()["g3"] == 1
    xy = counts.xy_counts(counts.project(df, [FD], "drop"))
    assert {(r["y"], r["b"]) for r in counts.y_counts(xy, "drop").collect()} == {("u", 2), ("v", 1)}
    nan = spark.createDataFrame([(float("nan"), "u"), (1.0, "u")], "x double, y string")
    assert score(nan, FD, ["g1"], "drop").first()["dom_x"] == 2
    with pytest.raises(ValueError):
        score(df, FD, nulls="both")


def test_majority_tie_by_text(spark):
    df = spark.createDataFrame([("a", 9), ("a", 10)], "x string, y int")
    x = counts.x_counts(counts.xy_counts(counts.project(df, [FD]))).first()
    assert x["majority"]["y"] == "10"


def test_missing_column_and_measure(spark):
    df = frame(spark, F1)
    with pytest.raises(ValueError, match="no column"):
        score(df, FDSpec(("z",), "y"))
    with pytest.raises(ValueError, match="no measure"):
        score(df, FD, ["g9"])
    with pytest.raises(ValueError):
        FDSpec((), "y")


def test_empty_table(spark):
    assert score(frame(spark, F1).limit(0), FD).count() == 0


@pytest.mark.parametrize("nulls", ["group", "drop"])
def test_batch_equals_single(spark, nulls):
    rows = [(random.Random(i).randrange(4), random.Random(i + 99).randrange(3), i % 5, None if i % 11 == 0 else "t") for i in range(80)]
    df = spark.createDataFrame(rows, "p int, q int, r int, s string")
    fds = [*unary_candidates(df), FDSpec(("p", "q"), "r")]
    batch = {r["fd_id"]: r for r in score(df, fds, nulls=nulls).collect()}
    for fd in (fds[0], fds[2], fds[9], fds[-1]):
        one = score(df, fd, nulls=nulls).first()
        for m in ("n", "dom_x", "dom_y", "dom_xy", *ALL_MEASURES):
            assert batch[fd.fd_id][m] == pytest.approx(one[m], abs=1e-9) if one[m] is not None else batch[fd.fd_id][m] is None
    ranks = [r["rank"] for r in ranked_report(df, ["p", "q", "r"]).orderBy("rank").collect()]
    assert ranks == [1, 2, 3, 4, 5, 6]


def test_large_groups_do_not_underflow(spark):
    cases = {"a": (10_000, 3_000, 3_000, 3.535709778e-05), "b": (60_000, 12_000, 12_000, 7.695143210e-06)}
    hist = spark.createDataFrame([(k, s, c, 1) for k, (_, a, b, _) in cases.items() for s, c in (("x", a), ("y", b))], "fd_id string, side string, count long, weight long")
    n = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "fd_id string, n long")
    for most in (4_000_000, 10):  # the series agrees where groups are large
        for r in information.expected_mi(hist, n, most_terms=most).collect():
            assert r["expected_mi"] == pytest.approx(cases[r["fd_id"]][3], rel=1e-6 if most > 10 else 2e-3)


def test_keys_have_no_information_above_expectation(spark):
    """H(Y) = E[MI] for a key: whatever rounding leaves of the difference must not count as a range."""
    for n in (1_500, 5_000, 20_000):
        got = score(spark.range(n).select(F.col("id").alias("x"), (F.col("id") % 10).alias("y")), FD).first()
        assert got["is_key"] and got["rfi_prime_plus"] == 0, n
        assert got["expected_mi"] == pytest.approx(got["h_y"], abs=1e-12), n
    # Null X in a key of the other rows: they count in n and H(Y), and leave a range.
    nulls = spark.createDataFrame([(i if i % 5 else None, i % 3) for i in range(300)], "x int, y int")
    got = score(nulls, FD, nulls="drop").first()
    want = max(0.0, (got["h_y"] - got["h_y_given_x"] - got["expected_mi"]) / (got["h_y"] - got["expected_mi"]))
    assert got["rfi_prime_plus"] == pytest.approx(want, abs=1e-9) and want > 0.9


def test_expectation_of_near_keys_is_exact(spark):
    """Log factorials of 36 million are 6e8, and their rounding was a ten-millionth of each probability."""
    n = 36_000_000
    xs, ys = {1: n - 2_000_000 - 600, 2: 1_000_000, 3: 200}, {17: 1_000_000, 19: 1_000_000}
    hist = spark.createDataFrame([("d", s, c, w) for s, counted in (("x", xs), ("y", ys)) for c, w in counted.items()], "fd_id string, side string, count long, weight long")
    got = information.expected_mi(hist, spark.createDataFrame([("d", n)], "fd_id string, n long")).first()
    mi, left = [], []
    for a, wa in xs.items():
        for b, wb in ys.items():
            for k in range(1, min(a, b) + 1):
                share = wa * wb * math.comb(b, k) * math.comb(n - b, a - k) / math.comb(n, a) * k / n
                mi.append(share * math.log2(k * n / (a * b)))
                left.append(share * math.log2(a / k))
    assert got["expected_mi"] == pytest.approx(math.fsum(mi), rel=1e-12)
    assert got["expected_h_y_given_x"] == pytest.approx(math.fsum(left), rel=1e-11)


def test_special_functions(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 10.0, 999.5, 6e5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", lgamma(F.col("x")).alias("v")).collect()
    for r in got:
        assert r["v"] == pytest.approx(math.lgamma(r["x"]), rel=1e-12, abs=1e-11)
    whole = [0, 1, 2, 7, 15, 16, 40, 150]
    for r in spark.createDataFrame([(m,) for m in whole], "m long").select("m", factorial_rest(F.col("m")).alias("v")).collect():
        m = r["m"]
        assert r["v"] == pytest.approx(math.log(math.factorial(m)) - (m * math.log(m) - m if m else 0), abs=2e-13)
    rows = spark.createDataFrame([(x, d) for x in (0.0, 0.3, 2.0, 9.0, 40.0, 5000.0) for d in (0, 1, 2, 7)], "x double, d int")
    for r in rows.select("x", "d", chi2_sf(F.col("x"), F.col("d")).alias("p")).collect():
        if r["d"] == 2:
            assert r["p"] == pytest.approx(math.exp(-r["x"] / 2), abs=1e-10)
        elif r["d"] == 1:
            assert r["p"] == pytest.approx(math.erfc(math.sqrt(r["x"] / 2)), abs=1e-10)
        elif r["d"] == 0:
            assert r["p"] == 1
