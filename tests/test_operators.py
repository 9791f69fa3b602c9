"""Violations, reliability, samples, profiles, index, generator, candidates."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from depscope.operators import candidates, generator, index, profile, sampling
from depscope.operators.reliability import ReliabilityConfig, chi_square, reliability, stability_by_first_value, stability_by_majority
from depscope.operators.violations import flag_violations, given_violations
from depscope.spec import FDSpec

FD = FDSpec(("x",), "y")


def pairs(spark, rows):
    return spark.createDataFrame([(i, r[0], r[1:]) for i, r in enumerate(rows)], "i long, x string, y string")


@pytest.mark.parametrize("rows,violations,stability", [(["a1", "a1", "a2", "b2", "b2", "c3"], 1, 0.52), (["a1"] * 5 + ["a2"] + ["b2"] * 4 + ["c1"] * 3 + ["c3"], 2, 0.555555556), (["a1", "b2", "c2"], 0, 1), (["a1", "a1", "b1"], 0, 1)])
def test_golden_reliability(spark, rows, violations, stability):
    df = pairs(spark, rows)
    assert flag_violations(df, FD).filter("is_violation").count() == violations
    assert stability_by_majority(df, FD).first()["score"] == pytest.approx(stability, abs=1e-8)
    got = reliability(df, FD, id_col="i").first()
    assert got["ar_violation_count"] == violations and got["ar_violation_rate"] == pytest.approx(violations / len(rows))
    assert not got["ar_is_reliable"] and got["ar_score"] == pytest.approx(stability, abs=1e-8)


def test_violations_and_nulls(spark):
    df = spark.createDataFrame([(0, None, "u"), (1, None, "v"), (2, "k", "u"), (3, "k", None), (4, "m", None)], "i long, x string, y string")
    assert [r["i"] for r in flag_violations(df, FD).filter("is_violation").collect()] == [3]
    assert flag_violations(df.limit(0), FD).count() == 0


def test_given_violations_count_once(spark):
    df = pairs(spark, ["a1", "a2", "b1"])
    given = spark.createDataFrame([(1,), (1,), (77,)], "row_id long")
    assert [r["i"] for r in given_violations(df, given, "i").filter("is_violation").collect()] == [1]


def test_clean_mode_uses_first_value(spark):
    df = pairs(spark, ["a2", "a1", "a1", "a1", "b1", "b1"])
    flagged = given_violations(df, spark.createDataFrame([(0,)], "row_id long"), "i")
    # Without row 0: a -> 1 three times, b -> 1 twice; one value, so nothing is left to chance.
    assert stability_by_first_value(flagged, FD, "i").first()["score"] == 1
    none = given_violations(df, spark.createDataFrame([], "row_id long"), "i")
    # a -> 2 (first seen, once), b -> 1 (twice): 1 - (1 - 2/3) * 2 / 3.
    assert stability_by_first_value(none, FD, "i").first()["score"] == pytest.approx(1 - (1 / 3) * 2 / 3)
    got = reliability(df, FD, ReliabilityConfig.clean(), given=spark.createDataFrame([(0,)], "row_id long"), id_col="i").first()
    assert got["ar_violation_count"] == 1 and not got["indep_used"] and got["indep_pvalue"] is None
    with pytest.raises(ValueError):
        reliability(df, FD, ReliabilityConfig.clean())


def test_rejection_by_rate_and_by_test(spark):
    df = spark.range(40).select(F.lit("a").alias("x"), F.col("id").cast("string").alias("y"), (F.col("id") % 2).alias("z"))
    got = reliability(df, FD).first()
    assert got["indep_rejected"] and got["indep_pvalue"] == -1 and got["ar_score"] == 1 and not got["ar_is_reliable"]
    cause = spark.range(400).select((F.col("id") % 8).alias("x"), F.when(F.col("id") % 5 == 0, F.col("id")).otherwise(F.col("id") % 8).alias("y"), F.when(F.col("id") % 5 == 0, "bad").otherwise("good").alias("z"), F.lit(None).cast("string").alias("w"))
    got = reliability(cause, FD).first()
    assert got["indep_used"] and got["indep_rejected"] and got["indep_pvalue"] < 1e-4


def test_chi_square_by_hand(spark):
    rows = [(True, "p", 1)] * 3 + [(False, "p", 1)] * 7 + [(True, "q", 1)] * 6 + [(False, "q", 1)] * 4 + [(True, None, 1)]
    got = {r["column"]: r for r in chi_square(spark.createDataFrame(rows, "is_violation boolean, c string, one int"), ["c", "one"]).collect()}
    want = sum((o - e) ** 2 / e for o, e in ((3, 4.5), (7, 5.5), (6, 4.5), (4, 5.5)))
    assert got["c"]["stat"] == pytest.approx(want) and got["c"]["df"] == 1
    assert got["one"]["p_value"] == 1 and chi_square(spark.createDataFrame([(True,)], "is_violation boolean"), []).count() == 0


def test_sampling(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    one, two = (sampling.fixed_sample(df, 50, "k", 7).orderBy("row_id").collect() for _ in range(2))
    assert one == two and [r["row_id"] for r in one] == list(range(50)) and [r["k"] for r in one] == sorted(r["k"] for r in one)
    assert sampling.fixed_sample(df, 900, "k").count() == 500
    assert sampling.policy_sample(df, "k").count() == 500
    chosen = sampling.fixed_sample(df, 50, "k", 7)
    old = spark.createDataFrame([(one[3]["k"],), (one[3]["k"],), (10_000,)], "row_id long")
    assert [r["row_id"] for r in sampling.reindex_violations(chosen, old, "k").collect()] == [3]
    assert sorted(r["row_id"] for r in sampling.with_row_ids(df.repartition(5)).collect()) == list(range(500))


def test_profiles(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", None), (None, 2), ("a", 2)], "x string, y int")
    got = {r["column"]: (r["distinct_values"], r["nulls"], r["rows"]) for r in profile.distinct_profile(df).collect()}
    assert got == {"x": (2, 1, 5), "y": (2, 1, 5)}
    assert [r["frequency"] for r in profile.rank_frequency(df, ["x"]).orderBy("rank").collect()] == [3, 1, 1]
    assert profile.approx_distinct(df, ["x", "y"]).first()[0] == 4
    assert profile.noise_potential(df, ["x"]).first()[0] == pytest.approx(1 / 5)
    one = spark.createDataFrame([("a", "a")] * 3, "x string, y string")
    got = profile.infer_settings(one, "x", "y").first()
    assert (got["tuples"], got["lhs_cardinality"], got["lhs_dist_alpha"], got["noise"]) == (3, 1, 1, 0)
    assert profile.infer_settings(one.limit(0), "x", "y").first()["tuples"] == 0
    assert profile.distinct_sketch(df, ["x"]).select(F.hll_sketch_estimate("sketch")).first()[0] in (2, 3)


def test_inferred_distribution(spark):
    import pandas as pd

    values = ["a"] * 5 + ["b"] * 3 + ["c"] * 3 + ["d"]
    ranks = pd.Series([0] * 5 + [1] * 3 + [2] * 3 + [3]) / 4
    m, v = ranks.mean(), ranks.var()
    got = profile.infer_column_settings(spark.createDataFrame([(x,) for x in values], "x string"), "x").first()
    assert got["dist_alpha"] == pytest.approx(m * (m * (1 - m) / v - 1)) and got["dist_beta"] == pytest.approx((1 - m) * (m * (1 - m) / v - 1))


def test_index(spark):
    df = spark.createDataFrame([(0, "a", "p"), (1, "b", "p"), (70_000, "a", "q"), (3, "a", None), (4, None, "p")], "i long, v string, o string")
    found = index.bitmap_index(df, "v", "i")
    assert {r["id"] for r in index.bitmap_lookup(found, "a").collect()} == {0, 3, 70_000}
    assert {r["value"]: r["rows"] for r in index.bitmap_cardinality(found).collect()} == {"a": 3, "b": 1, None: 1}
    assert sorted(x for r in index.value_rows(df, "v", "i").filter("value = 'a'").collect() for x in r["rows"]) == [0, 3, 70_000]
    assert {tuple(r) for r in index.cooccurrence(df, "v", ["o"]).collect()} == {("a", "o", "p"), ("a", "o", "q"), ("b", "o", "p")}


@pytest.mark.parametrize("kind", ["zipf", "beta"])
def test_generator(spark, kind):
    s = generator.GeneratorSettings(4000, 0.3, 2, 0.1, dist_type=kind, lhs_dist_alpha=1.2, lhs_dist_beta=3.0, noise=0.05)
    clean = generator.generate_clean(spark, s, 3)
    assert clean.groupBy("lhs_0", "lhs_1").agg(F.count_distinct("rhs").alias("n")).filter("n > 1").count() == 0
    base = {r["row_id"]: r["rhs"] for r in clean.collect()}
    assert base == {r["row_id"]: r["rhs"] for r in generator.generate_clean(spark, s, 3).collect()}
    for n_type in ("copy", "bogus", "typo"):
        noisy = generator.generate_syn(spark, dataclasses.replace(s, n_type=n_type), 3).collect()
        changed = [r for r in noisy if str(r["rhs"]) != str(base[r["row_id"]])]
        assert len(noisy) == 4000 and (len(changed) == 200 if n_type != "copy" else 150 <= len(changed) <= 200)
    with pytest.raises(ValueError, match="noise"):
        generator.generate_syn(spark, dataclasses.replace(s, noise=0.9), 3)


def test_zipf_frequencies(spark):
    n = 200_000
    got = spark.range(n).select(generator.zipf_value(F.col("id"), 50, 1.3, 5).alias("v")).groupBy("v").count().collect()
    weights = [k**-1.3 for k in range(1, 51)]
    for r in got:
        p = weights[r["v"]] / sum(weights)
        assert abs(r["count"] - n * p) < 6 * (n * p) ** 0.5


def test_candidate_filter(spark):
    rows = [("a", "b", "N", [1] * 9), ("a", "b", "N", [1]), ("a", "b", "P", [1] * 50), ("x", "y", "N", []), ("x", "y", "P", None), ("a", "x", "N", None)]
    df = spark.createDataFrame(rows, "left_col string, right_col string, sample_type string, violation_rows array<int>")
    kept = candidates.filter_candidates(df, 100, ["x", "y"]).collect()
    assert [(r["left_col"], r["right_col"], r["sample_type"]) for r in kept] == [("a", "b", "N"), ("a", "b", "P"), ("x", "y", "P"), ("a", "x", "N")]


def test_full_record_and_scenarios(spark, tmp_path):
    from depscope.plans.score import full_record

    got = full_record(pairs(spark, ["a1", "a1", "a2", "b2", "b2", "c3"]), FD, id_col="i").first()
    assert got["lhs"] == ["x"] and got["lhs_size"] == 1 and got["rhs"] == "y" and got["mu_plus"] == pytest.approx(0.393939394) and got["ar_score"] == pytest.approx(0.52)
    s = generator.GeneratorSettings(300, noise=0.0)
    path = generator.write_scenario(spark, "tiny", s, str(tmp_path))
    assert path.endswith("tiny_copy_0.0.parquet") and spark.read.parquet(path).columns == ["lhs_0", "rhs"] and generator.scenario_tags(s)["tuples"] == 300
    summary = {r["column"]: r for r in profile.column_summary(spark.createDataFrame([("a", None), ("b", None), ("a", None)], "p string, q string")).collect()}
    assert (summary["p"]["most_frequent"], summary["p"]["frequency"], summary["p"]["greatest"]) == ("a", 2, "b") and summary["q"]["nulls"] == 3 and summary["q"]["least"] is None
