"""Synthetic tables in which a dependency holds, and noise that breaks it to a given degree.

Everything is an expression over row numbers and a seed: rows are made where they are needed, in
any number of tasks, and the same settings give the same table.
"""

from __future__ import annotations

import dataclasses
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GeneratorSettings:
    """tuple_sel and rhs_sel: number of left-hand and right-hand values as shares of the rows.

    dist_type: "zipf" (alpha is the exponent) or "beta". n_type: "copy", "bogus" or "typo".
    """

    tuples: int
    tuple_sel: float = 0.5
    lhs_number: int = 1
    rhs_sel: float = 0.5
    dist_type: str = "zipf"
    lhs_dist_alpha: float = 1.01
    lhs_dist_beta: float = 1.0
    rhs_dist_alpha: float = 1.01
    rhs_dist_beta: float = 1.0
    noise: float = 0.01
    n_type: str = "copy"

    @property
    def lhs_cardinality(self) -> int:
        return max(1, int(self.tuples * self.tuple_sel))

    @property
    def rhs_cardinality(self) -> int:
        return max(1, int(self.tuples * self.rhs_sel))

    @property
    def lhs_columns(self) -> list[str]:
        return [f"lhs_{i}" for i in range(self.lhs_number)]


def uniform(seed: int, *what: Column) -> Column:
    """In (0, 1), fixed by the seed and the values."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *what), 12).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def zipf_value(row: Column, n: int, exponent: float, seed: int, tries: int = 12) -> Column:
    """0 .. n-1 with probabilities proportional to (value + 1)^-exponent.

    Rejection-inversion (Hörmann and Derflinger, 1996): the integral of the density is inverted and
    the result accepted unless it lies in the small area between density and bars. Over
    nine tries in ten are accepted at once, so the fixed number of tries never runs out in practice.
    """
    q = exponent

    def area(x):
        return math.log(x) if q == 1 else (x ** (1 - q) - 1) / (1 - q)

    def area_of(x: Column) -> Column:
        return F.log(x) if q == 1 else (F.pow(x, F.lit(1 - q)) - 1) / (1 - q)

    def back(y: Column) -> Column:
        return F.exp(y) if q == 1 else F.pow(1 + y * (1 - q), F.lit(1 / (1 - q)))

    low, high = area(1.5) - 1, area(n + 0.5)
    inverse = math.exp(area(2.5) - 2.0**-q) if q == 1 else (1 + (area(2.5) - 2.0**-q) * (1 - q)) ** (1 / (1 - q))
    near = 2 - inverse
    # Array functions, so that the text of the expression does not grow with every use of a try.
    u = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda i: high + uniform(seed, i, row) * (low - high))
    bar = lambda x: F.least(F.greatest(F.floor(x + 0.5), F.lit(1)), F.lit(n)).cast("double")
    draws = F.transform(F.transform(u, lambda v: F.struct(v.alias("u"), back(v).alias("x"))), lambda d: F.struct(d["u"].alias("u"), d["x"].alias("x"), bar(d["x"]).alias("k")))
    good = F.filter(draws, lambda d: (d["k"] - d["x"] <= near) | (d["u"] >= area_of(d["k"] + 0.5) - F.pow(d["k"], F.lit(-q))))
    return F.coalesce(F.get(good, F.lit(0))["k"].cast("long") - 1, F.lit(0).cast("long"))


def beta_value(row: Column, n: int, alpha: float, beta: float, seed: int, steps: int = 2048) -> Column:
    """0 .. n-1: floor of n times a beta variable, by linear interpolation in a table of its quantiles."""
    # Equal steps of an angle put points densely where a density may be infinite.
    t = (1 - np.cos(np.linspace(0, math.pi, 200_001))) / 2
    mid, width = (t[1:] + t[:-1]) / 2, np.diff(t)
    mass = np.exp((alpha - 1) * np.log(mid) + (beta - 1) * np.log1p(-mid)) * width
    cdf = np.concatenate([[0], np.cumsum(mass)])
    quantiles = np.interp(np.linspace(0, 1, steps + 1), cdf / cdf[-1], t)
    # One text, folded to a constant by the optimiser, instead of thousands of literals in the plan.
    table = F.split(F.lit(",".join(repr(float(v)) for v in quantiles)), ",").cast("array<double>")
    place = uniform(seed, F.lit("beta"), row) * steps
    i = F.floor(place).cast("int")
    x = F.element_at(table, i + 1) + (place - i) * (F.element_at(table, i + 2) - F.element_at(table, i + 1))
    return F.least(F.floor(x * n).cast("long"), F.lit(n - 1))


def _draw(row: Column, n: int, s: GeneratorSettings, side: str, seed: int) -> Column:
    alpha, beta = (s.lhs_dist_alpha, s.lhs_dist_beta) if side == "lhs" else (s.rhs_dist_alpha, s.rhs_dist_beta)
    return zipf_value(row, n, alpha, seed) if s.dist_type == "zipf" else beta_value(row, n, alpha, beta, seed)


def generate_clean(spark: SparkSession, s: GeneratorSettings, seed: int = 1) -> DataFrame:
    """(row_id, lhs_0 .., rhs), in which the left-hand columns determine rhs exactly.

    A row's left-hand side is a number written with ``lhs_number`` digits in the smallest base that
    has enough of them; its right-hand side is drawn from a hash of that number, which is
    what makes it a function of it.
    """
    card = s.lhs_cardinality
    base = max(1, math.ceil(card ** (1 / s.lhs_number) - 1e-9))
    while base**s.lhs_number < card:
        base += 1
    rows = spark.range(s.tuples).select(F.col("id").alias("row_id")).withColumn("number", _draw(F.col("row_id"), card, s, "lhs", seed))
    digits = [F.pmod(F.floor(F.col("number") / F.lit(base**i)), F.lit(base)).cast("int").alias(f"lhs_{i}") for i in range(s.lhs_number)]
    return rows.select("row_id", *digits, _draw(F.col("number"), s.rhs_cardinality, s, "rhs", seed + 1).cast("int").alias("rhs"))


def _numbered(rows: DataFrame, keys: list[str], order: str, buckets: int) -> DataFrame:
    """``rows`` with nth (from 1, by order and row_id, within the keys) and total (rows of the keys).

    Ranks are counted in buckets of the order, which is a hash and so evenly spread: rows are sorted within
    (keys, bucket) only, and over whole groups, or the whole table if there are no keys, only counts of buckets are summed.
    """
    rows = rows.withColumn("__bucket", F.floor(F.col(order) * buckets))
    place = [*keys, "__bucket"]
    by_bucket = rows.groupBy(*place).agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bucket.select(*[F.col(c).alias(f"__of_{c}") for c in place], F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("__before"), F.sum("c").over(whole).alias("total"))
    inner = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*place).orderBy(order, "row_id")))
    same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in place]
    return inner.join(starts, same).select(*[c for c in rows.columns if c != "__bucket"], (F.col("__before") + F.col("__nth")).alias("nth"), "total")


def noise_sites(df: DataFrame, s: GeneratorSettings, seed: int = 1, *, bucket_rows: int = 1 << 20) -> DataFrame:
    """(row_id, nth): exactly int(noise * tuples) rows, at most half of any group, uniform among such rows.

    In each group, half of its rows by a hash are open to noise; of all these, those first by another
    hash are taken. No task sorts more than about ``bucket_rows`` rows of a group.
    """
    k = int(s.noise * s.tuples)
    buckets = max(1, -(-s.tuples // bucket_rows))
    rows = df.select("row_id", *s.lhs_columns, uniform(seed, F.lit("place"), F.col("row_id")).alias("__place"))
    open_rows = _numbered(rows, s.lhs_columns, "__place", buckets).filter(F.col("nth") <= F.floor(F.col("total") / 2))
    sites = open_rows.select("row_id", uniform(seed, F.lit("site"), F.col("row_id")).alias("__site"))
    return _numbered(sites, [], "__site", buckets).filter(F.col("nth") <= k).select("row_id", "nth")


def add_noise(df: DataFrame, s: GeneratorSettings, seed: int = 1, typos: int = 3) -> DataFrame:
    """``df`` with the right-hand side changed at the noise sites.

    copy: the value of a random row (it may be the same value). bogus: new values above the largest,
    each once. typo: the text of the value with a number appended (rhs becomes a text). Raises
    ValueError if half of every group is less than the noise asked for.
    """
    if int(s.noise * s.tuples) == 0:
        return df
    from depscope.operators.profile import noise_potential

    potential = noise_potential(df, s.lhs_columns).first()[0]
    if potential < s.noise:
        raise ValueError(f"noise {s.noise} is not possible; at most {potential:.4f} of the rows can change")
    sites = noise_sites(df, s, seed)
    if s.n_type == "bogus":
        top = df.agg(F.max("rhs").alias("__top"))
        fresh = sites.join(F.broadcast(top))
        changed = fresh.select(F.col("row_id").alias("__id"), (F.col("__top") + F.col("nth")).cast("int").alias("__new"))
    elif s.n_type == "typo":
        extra = F.pmod(F.xxhash64(F.lit(seed), F.lit("typo"), F.col("row_id")), F.lit(typos)) + s.rhs_cardinality
        changed = sites.join(df.select("row_id", "rhs"), "row_id").select(F.col("row_id").alias("__id"), F.concat(F.col("rhs").cast("string"), extra.cast("string")).alias("__new"))
        df = df.withColumn("rhs", F.col("rhs").cast("string"))
    else:
        source = F.floor(uniform(seed, F.lit("copy"), F.col("row_id")) * s.tuples).cast("long")
        picks = sites.select(F.col("row_id").alias("__id"), source.alias("__from"))
        changed = picks.join(df.select(F.col("row_id").alias("__from"), F.col("rhs").alias("__new")), "__from").select("__id", "__new")
    out = df.join(changed, df["row_id"] == changed["__id"], "left")
    return out.select(*[df[c] for c in df.columns if c != "rhs"], F.coalesce("__new", df["rhs"]).alias("rhs"))


def generate_syn(spark: SparkSession, s: GeneratorSettings, seed: int = 1) -> DataFrame:
    """A clean table with noise."""
    clean = generate_clean(spark, s, seed)
    return add_noise(clean, s, seed) if s.noise > 0 else clean


def scenario_tags(s: GeneratorSettings) -> dict:
    """The settings as tags of an experiment."""
    return {"source": "synthetic", **dataclasses.asdict(s)}


def dataset_name(name: str, s: GeneratorSettings) -> str:
    """The name under which a scenario's table is kept."""
    return f"{name}_{s.n_type}_{s.noise}"


def write_scenario(spark: SparkSession, name: str, s: GeneratorSettings, folder: str, seed: int = 1) -> str:
    """Generate a scenario's table as Parquet unless it is there; returns its path."""
    path = f"{folder}/{dataset_name(name, s)}.parquet"
    generate_syn(spark, s, seed).drop("row_id").write.mode("ignore").parquet(path)
    return path


def _zipf(name: str, tuples: int, tuple_sel: float, lhs_number: int, rhs_sel: float) -> tuple[str, GeneratorSettings]:
    return name, GeneratorSettings(tuples, tuple_sel, lhs_number, rhs_sel)


#: Workloads of the published experiments (fixed values): rows, shares of left- and right-hand values, columns.
SCENARIOS = dict(
    [
        _zipf("zipf_50k", 50_000, 0.3, 3, 0.1),
        _zipf("zipf_100k", 100_000, 0.5, 3, 0.5),
        _zipf("zipf_250k", 250_000, 0.5, 7, 0.5),
        _zipf("zipf_500k", 500_000, 0.2, 7, 0.5),
        _zipf("zipf_1m", 1_000_000, 0.2, 7, 0.5),
        _zipf("zipf_2m", 2_000_000, 0.1, 3, 0.01),
        _zipf("zipf_10m", 10_000_000, 0.1, 7, 0.01),
        _zipf("zipf_10m_lowc", 10_000_000, 0.001, 7, 0.001),
        _zipf("zipf_10m_highc", 10_000_000, 0.5, 7, 0.5),
        _zipf("zipf_100m", 100_000_000, 0.1, 7, 0.01),
    ]
)
