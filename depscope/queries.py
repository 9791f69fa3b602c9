"""Registered queries over the standard tables, each with its SQL.

Every query runs over whole tables. The queries on dependencies take all of ``DEPENDENCIES`` and
return a row, or rows, for each.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depscope.functions import parsing, special
from depscope.operators import candidates, counts, generator, index, information, profile, reliability, sampling, violations
from depscope.plans import score as plans
from depscope.sources import readers, sinks
from depscope.spec import FDSpec

#: (table, left-hand columns, right-hand column)
DEPENDENCIES = [
    ("part", ("p_brand",), "p_type"),
    ("documents", ("source",), "lang"),
    ("documents", ("n_chars",), "lang"),
    ("labels", ("toxic",), "quality"),
    ("conversations", ("turn",), "role"),
    ("embeddings", ("vec_id",), "label"),
    ("orders", ("o_custkey",), "o_orderpriority"),
    ("lineitem", ("l_orderkey", "l_linenumber"), "l_partkey"),
    ("lineitem", ("l_partkey",), "l_suppkey"),
    ("lineitem", ("l_linestatus",), "l_returnflag"),
    ("lineitem", ("l_suppkey",), "l_returnflag"),
    ("events", ("user_id",), "event_type"),
]
#: Dependencies whose violations are studied: table, key of a row, dependency.
STUDIED = [("documents", "doc_id", FDSpec(("source",), "lang")), ("conversations", None, FDSpec(("turn",), "role")), ("orders", "o_orderkey", FDSpec(("o_custkey",), "o_orderpriority")), ("events", "event_id", FDSpec(("user_id",), "event_type"))]
DIGITS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_table() -> dict[str, list[FDSpec]]:
    out: dict[str, list[FDSpec]] = {}
    for name, lhs, rhs in DEPENDENCIES:
        out.setdefault(name, []).append(FDSpec(lhs, rhs, f"{name}: {'|'.join(lhs)} -> {rhs}"))
    return out


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def each_table(spark: SparkSession, sf_dir: str, plan: Callable[[DataFrame, list[FDSpec]], DataFrame]) -> DataFrame:
    """The union over tables of a plan for all dependencies of the table, in one scan each."""
    return _union([plan(table(spark, sf_dir, name), fds) for name, fds in by_table().items()])


def scored(spark: SparkSession, sf_dir: str, measures: Sequence[str]) -> DataFrame:
    return plans.score_tables([(table(spark, sf_dir, name), fds) for name, fds in by_table().items()], measures)


def _xy(df: DataFrame, fds: list[FDSpec]) -> DataFrame:
    # As texts in any case, so that all tables have one schema.
    out = counts.xy_counts(counts.project(df, fds))
    x = F.col("x") if dict(out.dtypes)["x"].startswith("array") else F.array(*[F.col(f"x.{f.name}").cast("string") for f in out.schema["x"].dataType.fields])
    return out.select("fd_id", F.array_join(x, "|").alias("x"), F.col("y").cast("string").alias("y"), "c")


def _texts(df: DataFrame) -> DataFrame:
    """Columns whose texts differ between engines as texts that do not: times to the microsecond, fractions to two digits."""
    how = {"timestamp": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), "timestamp_ntz": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), "double": lambda c: F.round(F.col(c) * 100).cast("long")}
    return df.select(*[how.get(t, F.col)(c).alias(c) for c, t in df.dtypes])


def _rounded(df: DataFrame) -> DataFrame:
    """Measures to six digits, without negative zeros."""
    return df.select(*[(F.round(c, DIGITS) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- SQL --------------------------------------------------------------------------------------


def _rows_sql() -> str:
    parts = []
    for name, fds in by_table().items():
        for fd in fds:
            x = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in fd.lhs)
            parts.append(f"SELECT '{fd.fd_id}' AS fd_id, {x} AS x, CAST({fd.rhs} AS VARCHAR) AS y FROM {name}")
    return " UNION ALL ".join(parts)


CTE = f"""
WITH r AS ({_rows_sql()}),
xy AS (SELECT fd_id, x, y, CAST(count(*) AS BIGINT) AS c FROM r GROUP BY fd_id, x, y),
gx AS (SELECT fd_id, x, CAST(sum(c) AS BIGINT) AS a, CAST(max(c) AS BIGINT) AS m, CAST(count(*) AS BIGINT) AS k FROM xy GROUP BY fd_id, x),
gy AS (SELECT fd_id, y, CAST(sum(c) AS BIGINT) AS b FROM xy GROUP BY fd_id, y),
tx AS (SELECT fd_id, CAST(sum(a) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS d, CAST(sum(a - m) AS DOUBLE) AS del, CAST(sum(CASE WHEN k > 1 THEN a ELSE 0 END) AS DOUBLE) AS viol FROM gx GROUP BY fd_id),
txy AS (SELECT xy.fd_id, sum(CAST(c AS DOUBLE) * c / a) AS s, sum(c * log2(CAST(c AS DOUBLE) / a)) AS l, sum(CAST(c AS DOUBLE) * (a - c)) AS p FROM xy JOIN gx ON xy.fd_id = gx.fd_id AND xy.x = gx.x GROUP BY xy.fd_id),
ty AS (SELECT gy.fd_id, sum(CAST(b AS DOUBLE) * b) / (n * n) AS q, -sum(b / n * log2(b / n)) AS h FROM gy JOIN tx ON gy.fd_id = tx.fd_id GROUP BY gy.fd_id, n),
t AS (SELECT tx.fd_id, n, d, del, viol, s / n AS pdep_xy, q AS pdep_y, h AS h_y, -l / n AS h_yx, p FROM tx JOIN txy ON tx.fd_id = txy.fd_id JOIN ty ON tx.fd_id = ty.fd_id)
"""
# E[MI]: pairs of counts with their weights, one term per possible overlap.
EXPECTED = """,
hx AS (SELECT fd_id, a, count(*) AS w FROM gx GROUP BY fd_id, a),
hy AS (SELECT fd_id, b, count(*) AS w FROM gy GROUP BY fd_id, b),
pr AS (SELECT hx.fd_id, CAST(n AS BIGINT) AS n, a, b, CAST(hx.w AS DOUBLE) * hy.w AS w FROM hx JOIN hy ON hx.fd_id = hy.fd_id JOIN t ON hx.fd_id = t.fd_id),
ks AS (SELECT fd_id, n, a, b, w, unnest(generate_series(greatest(1, a + b - n), least(a, b))) AS k FROM pr),
em AS (SELECT fd_id, sum(w * exp(lgamma(CAST(a + 1 AS DOUBLE)) + lgamma(CAST(b + 1 AS DOUBLE)) + lgamma(CAST(n - a + 1 AS DOUBLE)) + lgamma(CAST(n - b + 1 AS DOUBLE)) - lgamma(CAST(n + 1 AS DOUBLE))
  - lgamma(CAST(k + 1 AS DOUBLE)) - lgamma(CAST(a - k + 1 AS DOUBLE)) - lgamma(CAST(b - k + 1 AS DOUBLE)) - lgamma(CAST(n - a - b + k + 1 AS DOUBLE)))
  * (CAST(k AS DOUBLE) / n) * log2(CAST(k AS DOUBLE) * n / (CAST(a AS DOUBLE) * b))) AS e FROM ks GROUP BY fd_id)
"""


def _r(expression: str) -> str:
    return f"round({expression}, {DIGITS}) + 0.0"


MEASURE_SQL = {
    "pdep_xy": "pdep_xy",
    "pdep_y": "pdep_y",
    "mu": "CASE WHEN n = d THEN 1.0 WHEN pdep_y = 1 THEN NULL ELSE 1 - (1 - pdep_xy) / (1 - pdep_y) * (n - 1) / (n - d) END",
    "mu_plus": "CASE WHEN n = d THEN 1.0 WHEN pdep_y = 1 THEN 0.0 ELSE greatest(0.0, 1 - (1 - pdep_xy) / (1 - pdep_y) * (n - 1) / (n - d)) END",
    "lhs_uniqueness": "d / n",
    "h_y": "h_y",
    "h_y_given_x": "h_yx",
    "fi": "CASE WHEN h_y > 1e-12 THEN (h_y - h_yx) / h_y END",
    "g1": "1 - p / (n * n)",
    "g2": "1 - viol / n",
    "g3": "1 - del / n",
    "g3_prime": "CASE WHEN n = d THEN CASE WHEN del = 0 THEN 1.0 ELSE 0.0 END ELSE (n - d - del) / (n - d) END",
}
EXPECTED_SQL = {
    "expected_mi": "e",
    "bias": "CASE WHEN h_y > 1e-12 THEN e / h_y END",
    "rfi": "CASE WHEN h_y > 1e-12 THEN (h_y - h_yx - e) / h_y END",
    "rfi_prime_plus": "CASE WHEN h_y > e + 1e-12 THEN greatest(0.0, (h_y - h_yx - e) / (h_y - e)) ELSE 0.0 END",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _measure_query(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(scored(spark, sf_dir, [name]).select("fd_id", name))

    run.__name__ = name
    sql = f"{CTE} SELECT fd_id, {_r(MEASURE_SQL[name])} AS {name} FROM t" if name in MEASURE_SQL else f"{CTE}{EXPECTED} SELECT t.fd_id, {_r(EXPECTED_SQL[name])} AS {name} FROM t JOIN em ON t.fd_id = em.fd_id"
    query(sql)(run)


for _name in (*MEASURE_SQL, *EXPECTED_SQL):
    _measure_query(_name)


# --- counts -----------------------------------------------------------------------------------


@query(f"{CTE} SELECT fd_id, x, y, c FROM xy")
def fd_counts_xy(spark, sf_dir):
    return each_table(spark, sf_dir, _xy)


@query(f"{CTE} SELECT fd_id, x, a, m, k FROM gx")
def fd_counts_x(spark, sf_dir):
    return each_table(spark, sf_dir, lambda df, fds: counts.x_counts(_xy(df, fds).withColumn("x", F.array("x"))).select("fd_id", F.array_join("x", "|").alias("x"), "a", "m", "k"))


@query(f"{CTE} SELECT fd_id, y, b FROM gy")
def fd_counts_y(spark, sf_dir):
    return each_table(spark, sf_dir, lambda df, fds: counts.y_counts(_xy(df, fds)))


@query(f"{CTE} SELECT fd_id, 'x' AS side, a AS count, CAST(count(*) AS BIGINT) AS weight FROM gx GROUP BY fd_id, a UNION ALL SELECT fd_id, 'y', b, CAST(count(*) AS BIGINT) FROM gy GROUP BY fd_id, b")
def fd_count_hist(spark, sf_dir):
    def plan(df, fds):
        xy = counts.xy_counts(counts.project(df, fds))
        return counts.count_histograms(counts.x_counts(xy), counts.y_counts(xy))

    return each_table(spark, sf_dir, plan)


_ALL = ", ".join(f"{_r(v)} AS {k}" for k, v in {**MEASURE_SQL, **EXPECTED_SQL}.items())


@query(f"{CTE}{EXPECTED} SELECT t.fd_id, CAST(n AS BIGINT) AS n, CAST(d AS BIGINT) AS dom_x, n = d AS is_key, {_ALL} FROM t JOIN em ON t.fd_id = em.fd_id")
def fd_batch_all_measures(spark, sf_dir):
    return _rounded(scored(spark, sf_dir, plans.ALL_MEASURES).select("fd_id", "n", "dom_x", "is_key", *MEASURE_SQL, *EXPECTED_SQL))


PART_COLUMNS = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
_PAIRS = [(a, b) for a in PART_COLUMNS for b in PART_COLUMNS if a != b]
_PAIR_ROWS = " UNION ALL ".join(f"SELECT '{a} -> {b}' AS fd_id, CAST({a} AS VARCHAR) AS x, CAST({b} AS VARCHAR) AS y FROM part" for a, b in _PAIRS)


@query(f"WITH r AS ({_PAIR_ROWS}),{CTE.split('),', 1)[1]}, s AS (SELECT fd_id, {_r(MEASURE_SQL['g3_prime'])} AS g3_prime FROM t) SELECT fd_id, g3_prime, CAST(row_number() OVER (ORDER BY g3_prime DESC, fd_id) AS INTEGER) AS rank FROM s")
def fd_ranked_report(spark, sf_dir):
    out = _rounded(plans.ranked_report(table(spark, sf_dir, "part"), PART_COLUMNS, ["g3_prime"], "g3_prime"))
    return out.select("fd_id", "g3_prime", "rank")


# --- majorities, violations, reliability --------------------------------------------------------


@query(f"{CTE}, o AS (SELECT fd_id, x, y, c, row_number() OVER (PARTITION BY fd_id, x ORDER BY c DESC, y) AS i FROM xy) SELECT fd_id, x, y AS majority_y, c AS majority_count FROM o WHERE i = 1")
def fd_majority(spark, sf_dir):
    def plan(df, fds):
        x = counts.x_counts(_xy(df, fds).withColumn("x", F.array("x")))
        return x.select("fd_id", F.array_join("x", "|").alias("x"), F.col("majority.y").alias("majority_y"), F.col("majority.c").alias("majority_count"))

    return each_table(spark, sf_dir, plan)


def _flags_sql(name: str, lhs: str, rhs: str) -> str:
    return f"""c AS (SELECT {lhs} AS x, CAST({rhs} AS VARCHAR) AS y, count(*) AS c FROM {name} GROUP BY 1, 2),
o AS (SELECT x, y, c, row_number() OVER (PARTITION BY x ORDER BY c DESC, y) AS i FROM c),
m AS (SELECT x, y, c FROM o WHERE i = 1),
f AS (SELECT t.*, CASE WHEN CAST({rhs} AS VARCHAR) <> m.y THEN 1 ELSE 0 END AS v FROM {name} t JOIN m ON t.{lhs} = m.x)"""


@query(f"WITH {_flags_sql('documents', 'source', 'lang')} SELECT doc_id FROM f WHERE v = 1")
def fd_violations(spark, sf_dir):
    return violations.flag_violations(table(spark, sf_dir, "documents"), STUDIED[0][2]).filter("is_violation").select("doc_id")


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {_flags_sql(t, fd.lhs[0], fd.rhs)} SELECT '{t}' AS table_name, CAST(sum(v) AS BIGINT) AS violations, round(sum(v) / CAST(count(*) AS DOUBLE), 6) AS violation_rate FROM f)" for t, _, fd in STUDIED))
def fd_violation_rate(spark, sf_dir):
    out = []
    for name, _, fd in STUDIED:
        flagged = violations.flag_violations(table(spark, sf_dir, name), fd)
        out.append(flagged.agg(F.lit(name).alias("table_name"), F.sum(F.col("is_violation").cast("long")).alias("violations"), F.round(F.avg(F.col("is_violation").cast("double")), 6).alias("violation_rate")))
    return _union(out).select("table_name", "violations", "violation_rate")


@query("WITH g AS (SELECT event_id FROM events WHERE value > 90), f AS (SELECT e.event_id, g.event_id IS NOT NULL AS is_violation FROM events e LEFT JOIN g ON e.event_id = g.event_id) SELECT event_id, is_violation FROM f")
def fd_given_violations(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    given = events.filter("value > 90").select(F.col("event_id").alias("row_id"))
    return violations.given_violations(events, given, "event_id").select("event_id", "is_violation")


def _rest_sql(columns: Sequence[str]) -> str:
    """The chi-square statistics of rows f with a violation mark v, by column."""
    return f"""l AS ({' UNION ALL '.join(f"SELECT {i} AS ordinal, '{c}' AS col, CAST({c} AS VARCHAR) AS value, v FROM f" for i, c in enumerate(columns))}),
g AS (SELECT ordinal, col, value, CAST(sum(v) AS DOUBLE) AS v, CAST(sum(1 - v) AS DOUBLE) AS h FROM l WHERE value IS NOT NULL GROUP BY ordinal, col, value),
t AS (SELECT ordinal, sum(v) AS tv, sum(h) AS th FROM g GROUP BY ordinal),
s AS (SELECT g.ordinal, col, sum((v - tv * (v + h) / (tv + th)) * (v - tv * (v + h) / (tv + th)) / (tv * (v + h) / (tv + th)) + (h - th * (v + h) / (tv + th)) * (h - th * (v + h) / (tv + th)) / (th * (v + h) / (tv + th))) AS stat, count(*) - 1 AS df FROM g JOIN t ON g.ordinal = t.ordinal WHERE tv > 0 AND th > 0 GROUP BY g.ordinal, col)"""


#: Columns of the studied tables outside the dependency and the key, in the tables' order.
REST = {"documents": ("text", "n_chars"), "conversations": ("conv_id", "text"), "orders": ("o_orderstatus", "o_totalprice", "o_orderdate"), "events": ("ts", "value", "props")}
_CHI = f"WITH {_flags_sql('orders', 'o_custkey', 'o_orderpriority')}, {_rest_sql(REST['orders'])}"


@query(f'{_CHI} SELECT CAST(ordinal AS INTEGER) AS ordinal, col AS "column", round(stat, 4) AS stat, CAST(df AS BIGINT) AS df FROM s')
def chi2_stat(spark, sf_dir):
    flagged = violations.flag_violations(table(spark, sf_dir, "orders"), STUDIED[2][2])
    return reliability.chi_square(flagged, REST["orders"]).select("ordinal", "column", F.round("stat", 4).alias("stat"), "df")


@query("""WITH q AS (SELECT unnest(generate_series(1, 40)) AS df), x AS (SELECT unnest(generate_series(1, 60)) AS i), p AS (SELECT CAST(df AS DOUBLE) AS d, df, i, i * 0.75 AS stat FROM q CROSS JOIN x),
k AS (SELECT d, df, i, stat, unnest(generate_series(0, 400)) AS j FROM p)
SELECT CAST(df AS INTEGER) AS df, CAST(i AS INTEGER) AS i, round(greatest(0.0, 1 - sum(exp(d / 2 * ln(stat / 2) - stat / 2 + j * ln(stat / 2) - lgamma(d / 2 + j + 1)))), 6) + 0.0 AS p_value FROM k GROUP BY df, i""")
def chi2_tail(spark, sf_dir):
    grid = spark.range(1, 41).select(F.col("id").cast("int").alias("df")).join(F.broadcast(spark.range(1, 61).select(F.col("id").cast("int").alias("i"))))
    return grid.select("df", "i", (F.round(special.chi2_sf(F.col("i") * 0.75, F.col("df")), 6) + 0.0).alias("p_value"))


def _stability_sql(name: str, fd: FDSpec) -> str:
    return f"""SELECT * FROM (WITH {_flags_sql(name, fd.lhs[0], fd.rhs)}, lv AS (SELECT CAST(sum(c) AS DOUBLE) AS n FROM m), vf AS (SELECT y, CAST(sum(c) AS DOUBLE) AS f FROM m GROUP BY y)
SELECT '{name}' AS table_name, round(1 - sum(CASE WHEN c > 1 THEN (1 - f / n) * c ELSE 0 END) / max(n), 6) AS score FROM m JOIN vf ON m.y = vf.y CROSS JOIN lv)"""


@query(" UNION ALL ".join(_stability_sql(t, fd) for t, _, fd in STUDIED))
def ar_stability(spark, sf_dir):
    return _union([reliability.stability_by_majority(table(spark, sf_dir, t), fd).select(F.lit(t).alias("table_name"), F.round("score", 6).alias("score")) for t, _, fd in STUDIED])


@query("""WITH k AS (SELECT event_id, user_id, event_type FROM events WHERE value <= 90), c AS (SELECT user_id, event_type AS y, count(*) AS c, min(event_id) AS i FROM k GROUP BY user_id, event_type),
o AS (SELECT y, c, row_number() OVER (PARTITION BY user_id ORDER BY i) AS r FROM c), m AS (SELECT y, c FROM o WHERE r = 1), lv AS (SELECT CAST(sum(c) AS DOUBLE) AS n FROM m), vf AS (SELECT y, CAST(sum(c) AS DOUBLE) AS f FROM m GROUP BY y)
SELECT round(1 - sum(CASE WHEN c > 1 THEN (1 - f / n) * c ELSE 0 END) / max(n), 6) AS score FROM m JOIN vf ON m.y = vf.y CROSS JOIN lv""")
def ar_stability_clean(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    given = events.filter("value > 90").select(F.col("event_id").alias("row_id"))
    flagged = violations.given_violations(events, given, "event_id")
    return reliability.stability_by_first_value(flagged, STUDIED[3][2], "event_id").select(F.round("score", 6).alias("score"))


_TAIL = "greatest(0.0, 1 - sum(exp(df / 2.0 * ln(stat / 2) - stat / 2 + j * ln(stat / 2) - lgamma(df / 2.0 + j + 1))))"


#: p-values of the statistics s, and which column rejects.
_TESTS = f"""terms AS (SELECT ordinal, stat, df, unnest(generate_series(0, CAST(ceil(greatest(stat / 2 - df / 2.0, 0.0) + 14 * sqrt(stat / 2 + df / 2.0) + 60) AS BIGINT))) AS j FROM s WHERE stat > 0 AND df > 0),
p AS (SELECT ordinal, {_TAIL} AS p FROM terms GROUP BY ordinal, stat, df),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(v) AS BIGINT) AS v FROM f),
w AS (SELECT min(CASE WHEN p < 1e-4 THEN ordinal END) AS hit FROM p)"""
_MAJORITY_SCORE = """lv AS (SELECT CAST(sum(c) AS DOUBLE) AS t FROM m), vf AS (SELECT y, CAST(sum(c) AS DOUBLE) AS g FROM m GROUP BY y),
st AS (SELECT 1 - sum(CASE WHEN c > 1 THEN (1 - g / t) * c ELSE 0 END) / max(t) AS score FROM m JOIN vf ON m.y = vf.y CROSS JOIN lv)"""
_VERDICT = """ar_score, v AS ar_violation_count, round(rate, 6) AS ar_violation_rate, NOT (by_rate OR by_test) AND score <= 0.5 AS ar_is_reliable, v > 0 AS indep_used, by_rate OR by_test AS indep_rejected,
round(CASE WHEN by_rate THEN -1.0 WHEN v > 0 THEN coalesce(first_p, last_p, 1.0) END, 6) + 0.0 AS indep_pvalue"""


def _verdict_sql(name: str, fd: FDSpec) -> str:
    last = len(REST[name]) - 1
    return f"""SELECT * FROM (WITH {_flags_sql(name, fd.lhs[0], fd.rhs)}, {_rest_sql(REST[name])}, {_TESTS}, {_MAJORITY_SCORE},
e AS (SELECT n.v, n.v / n.n AS rate, n.v / n.n > 0.5 AS by_rate, w.hit IS NOT NULL AS by_test, st.score, (SELECT max(p) FROM p WHERE ordinal = w.hit) AS first_p, (SELECT max(p) FROM p WHERE ordinal = {last}) AS last_p FROM n CROSS JOIN w CROSS JOIN st)
SELECT '{fd.fd_id}' AS fd_id, round(CASE WHEN by_rate OR by_test THEN 1.0 ELSE score END, 6) AS {_VERDICT}, round(score, 6) AS ar_score_fused FROM e)"""


@query(_verdict_sql("orders", STUDIED[2][2]))
def ar_verdict(spark, sf_dir):
    return _rounded(reliability.reliability(table(spark, sf_dir, "orders"), STUDIED[2][2], id_col="o_orderkey"))


@query(f"SELECT CAST(n AS BIGINT) AS n, CAST(d AS BIGINT) AS dom_x, {_r(MEASURE_SQL['mu'])} AS mu, {_r(MEASURE_SQL['g3_prime'])} AS g3_prime, {_r(MEASURE_SQL['h_y'])} AS h_y, v.ar_score, v.ar_violation_count, v.indep_rejected FROM (SELECT * FROM ({CTE} SELECT * FROM t) q WHERE fd_id = 'orders: o_custkey -> o_orderpriority') m CROSS JOIN ({ORACLES['ar_verdict']}) v")
def fd_full_record(spark, sf_dir):
    return _rounded(plans.full_record(table(spark, sf_dir, "orders"), STUDIED[2][2], id_col="o_orderkey").select("n", "dom_x", "mu", "g3_prime", "h_y", "ar_score", "ar_violation_count", "indep_rejected"))


@query(" UNION ALL ".join(_verdict_sql(t, fd) for t, _, fd in STUDIED))
def ar_verdicts_all(spark, sf_dir):
    """Verdicts, with p-values, of all studied dependencies."""
    return _union([_rounded(reliability.reliability(table(spark, sf_dir, t), fd, id_col=key)) for t, key, fd in STUDIED])


_CLEAN_FLAGS = "f AS (SELECT *, CASE WHEN value > 90 THEN 1 ELSE 0 END AS v FROM events)"


@query(f"""WITH {_CLEAN_FLAGS}, {_rest_sql(REST['events'])}, {_TESTS}, st AS ({ORACLES['ar_stability_clean'].replace('round(1 - sum(CASE WHEN c > 1 THEN (1 - f / n) * c ELSE 0 END) / max(n), 6)', '1 - sum(CASE WHEN c > 1 THEN (1 - f / n) * c ELSE 0 END) / max(n)')}),
mj AS ({_stability_sql('events', STUDIED[3][2])}),
e AS (SELECT n.v, n.v / n.n AS rate, n.v / n.n > 0.5 AS by_rate, w.hit IS NOT NULL AS by_test, st.score, mj.score AS fused, (SELECT max(p) FROM p WHERE ordinal = w.hit) AS first_p, (SELECT max(p) FROM p WHERE ordinal = 2) AS last_p FROM n CROSS JOIN w CROSS JOIN st CROSS JOIN mj)
SELECT 'tested' AS mode, round(CASE WHEN by_rate OR by_test THEN 1.0 ELSE score END, 6) AS {_VERDICT}, fused AS ar_score_fused FROM e
UNION ALL SELECT 'untested', round(score, 6), v, round(rate, 6), score <= 0.5, FALSE, FALSE, NULL, fused FROM e""")
def ar_verdict_clean(spark, sf_dir):
    """Given violations, with the independence test and without."""
    events = table(spark, sf_dir, "events")
    given = events.filter("value > 90").select(F.col("event_id").alias("row_id"))
    configs = {"tested": reliability.ReliabilityConfig.clean(use_independence_test=True), "untested": reliability.ReliabilityConfig.clean()}
    each = [reliability.reliability(events, STUDIED[3][2], c, given=given, id_col="event_id").withColumn("mode", F.lit(m)).drop("fd_id") for m, c in configs.items()]
    return _rounded(_union(each))


# --- samples, profiles, index -------------------------------------------------------------------


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS row_id FROM (SELECT o_orderkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42'), o_orderkey LIMIT 1000)")
def sample_fixed(spark, sf_dir):
    """An operator whose limit is the feature: exactly 1000 rows."""
    return sampling.fixed_sample(table(spark, sf_dir, "orders").select("o_orderkey"), 1000, "o_orderkey", 42)


_TEXTS = {"ts": "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')", "value": "CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)"}
_ALL_EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_values, CAST(count(*) - count({c}) AS BIGINT) AS nulls, CAST(count(*) AS BIGINT) AS rows FROM events" for c in _ALL_EVENT_COLUMNS))
def distinct_profile(spark, sf_dir):
    return profile.distinct_profile(table(spark, sf_dir, "events"), _ALL_EVENT_COLUMNS)


@query(" UNION ALL ".join(f"""SELECT * FROM (WITH v AS (SELECT {_TEXTS.get(c, f'CAST({c} AS VARCHAR)')} AS v, CAST(count(*) AS BIGINT) AS c FROM events GROUP BY 1), o AS (SELECT v, c, row_number() OVER (ORDER BY c DESC, v) AS i FROM v WHERE v IS NOT NULL)
SELECT '{c}' AS "column", CAST(sum(v.c) AS BIGINT) AS rows, CAST(coalesce(sum(CASE WHEN v.v IS NULL THEN v.c END), 0) AS BIGINT) AS nulls, CAST(count(v.v) AS BIGINT) AS distinct_values, min(v.v) AS least, max(v.v) AS greatest, max(CASE WHEN i = 1 THEN o.v END) AS most_frequent, max(CASE WHEN i = 1 THEN o.c END) AS frequency FROM v LEFT JOIN o ON v.v = o.v)""" for c in _ALL_EVENT_COLUMNS))
def column_summary(spark, sf_dir):
    return profile.column_summary(_texts(table(spark, sf_dir, "events")))


@query("SELECT CAST(count(*) AS BIGINT) AS pairs, TRUE AS close FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)")
def approx_distinct(spark, sf_dir):
    """The sketch beside the exact number: within three times its standard error."""
    lines, columns = table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"]
    both = lines.agg(F.countDistinct(*columns).alias("pairs")).join(F.broadcast(profile.approx_distinct(lines, columns)))
    return both.select("pairs", (F.abs(F.col("approx_distinct") - F.col("pairs")) <= 3 * profile.RSD_14 * F.col("pairs")).alias("close"))


@query("SELECT CAST(row_number() OVER (ORDER BY c DESC) AS BIGINT) AS rank, CAST(c AS BIGINT) AS frequency FROM (SELECT count(*) AS c FROM events GROUP BY user_id)")
def rank_frequency(spark, sf_dir):
    return profile.rank_frequency(table(spark, sf_dir, "events"), ["user_id"])


@query("WITH g AS (SELECT CAST(count(*) AS DOUBLE) AS c FROM events GROUP BY user_id), e AS (SELECT min(c) AS lo, max(c) AS hi FROM g) SELECT CAST(least(floor((c - lo) / ((hi - lo) / 50)), 49) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS groups FROM g CROSS JOIN e GROUP BY 1")
def count_histogram(spark, sf_dir):
    return profile.count_histogram(table(spark, sf_dir, "events"), ["user_id"])


@query("SELECT round(sum(CAST(floor(c / 2) AS DOUBLE)) / sum(c), 6) AS noise_potential FROM (SELECT count(*) AS c FROM part GROUP BY p_brand)")
def noise_potential(spark, sf_dir):
    return profile.noise_potential(table(spark, sf_dir, "part"), ["p_brand"]).select(F.round("noise_potential", 6).alias("noise_potential"))


def _moments_sql(column: str, side: str) -> str:
    return f"""v{side} AS (SELECT CAST(count(*) AS DOUBLE) AS f, CAST(row_number() OVER (ORDER BY count(*) DESC, {column}) - 1 AS DOUBLE) AS r FROM part GROUP BY {column}),
k{side} AS (SELECT CAST(count(*) AS DOUBLE) AS card, sum(f) AS n FROM v{side}),
m{side} AS (SELECT max(n) AS n, max(card) AS card, sum(f * r / card) / max(n) AS mean, sum(f * (r / card) * (r / card)) AS sq FROM v{side} CROSS JOIN k{side}),
b{side} AS (SELECT n, card, mean, (sq - n * mean * mean) / (n - 1) AS var FROM m{side})"""


@query(f"""WITH {_moments_sql('p_brand', 'l')}, {_moments_sql('p_type', 'r')}, c AS (SELECT p_brand, p_type, count(*) AS c FROM part GROUP BY 1, 2), z AS (SELECT sum(a - m) / CAST(sum(a) AS DOUBLE) AS noise FROM (SELECT sum(c) AS a, max(c) AS m FROM c GROUP BY p_brand))
SELECT CAST(bl.n AS BIGINT) AS tuples, CAST(bl.card AS BIGINT) AS lhs_cardinality, round(bl.mean * (bl.mean * (1 - bl.mean) / bl.var - 1), 6) AS lhs_dist_alpha, round((1 - bl.mean) * (bl.mean * (1 - bl.mean) / bl.var - 1), 6) AS lhs_dist_beta,
CAST(br.card AS BIGINT) AS rhs_cardinality, round(br.mean * (br.mean * (1 - br.mean) / br.var - 1), 6) AS rhs_dist_alpha, round((1 - br.mean) * (br.mean * (1 - br.mean) / br.var - 1), 6) AS rhs_dist_beta, round(noise, 6) AS noise FROM bl CROSS JOIN br CROSS JOIN z""")
def infer_settings(spark, sf_dir):
    return _rounded(profile.infer_settings(table(spark, sf_dir, "part"), "p_brand", "p_type", noise=True))


@query("WITH a AS (SELECT unnest(generate_series(1, 100)) / 100.0 AS alpha), b AS (SELECT unnest(generate_series(10, 100)) / 10.0 AS beta) SELECT CAST(alpha AS DOUBLE) AS alpha, CAST(beta AS DOUBLE) AS beta, round(CAST(2 * (beta - alpha) * sqrt(alpha + beta + 1) / ((alpha + beta + 2) * sqrt(alpha * beta)) AS DOUBLE), 6) + 0.0 AS skewness FROM a CROSS JOIN b")
def beta_skewness(spark, sf_dir):
    return _rounded(profile.skew_lookup(spark))


@query("SELECT DISTINCT source AS value, 'lang' AS other_column, lang AS other_value FROM documents")
def cooccurrence(spark, sf_dir):
    return index.cooccurrence(table(spark, sf_dir, "documents"), "source", ["lang"])


@query("SELECT source AS value, CAST(floor(doc_id / 32768) AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1, 2")
def value_rowids(spark, sf_dir):
    rows = index.value_rows(table(spark, sf_dir, "documents"), "source", "doc_id")
    return rows.select("value", "bucket", F.size("rows").cast("long").alias("n"), F.get("rows", F.lit(0)).alias("first_id"), F.element_at("rows", -1).alias("last_id"))


@query("SELECT event_type AS value, CAST(count(*) AS BIGINT) AS rows FROM events GROUP BY 1")
def bitmap_cardinality(spark, sf_dir):
    return index.bitmap_cardinality(index.bitmap_index(table(spark, sf_dir, "events"), "event_type", "event_id"))


@query("SELECT doc_id AS id FROM documents WHERE source = 'src3'")
def bitmap_lookup(spark, sf_dir):
    return index.bitmap_lookup(index.bitmap_index(table(spark, sf_dir, "documents"), "source", "doc_id"), "src3")


# --- candidates, logs, results, generator ---------------------------------------------------------

_TYPE_SIZE = "SELECT p_partkey, 'p_brand' AS left_col, CASE WHEN p_size % 2 = 0 THEN 'p_type' ELSE 'p_size' END AS right_col, CASE WHEN p_size % 3 = 0 THEN 'N' ELSE 'P' END AS sample_type, p_size AS v FROM part"


@query(f"SELECT p_partkey FROM ({_TYPE_SIZE}) WHERE NOT (sample_type = 'N' AND v / CAST((SELECT count(*) FROM part) AS DOUBLE) > 0.05)")
def candidate_filter(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    listed = part.selectExpr("p_partkey", "'p_brand' AS left_col", "CASE WHEN p_size % 2 = 0 THEN 'p_type' ELSE 'p_size' END AS right_col", "CASE WHEN p_size % 3 = 0 THEN 'N' ELSE 'P' END AS sample_type", "sequence(1, p_size) AS violation_rows")
    return candidates.filter_candidates(listed, part.count(), candidates.numeric_columns(part)).select("p_partkey")


@query("SELECT CAST(o_custkey AS VARCHAR) AS run_id, 'Total' AS name, CAST(CAST(arg_max(o_totalprice, o_orderkey) * 100 AS BIGINT) AS VARCHAR) AS value, 'int' AS kind FROM orders GROUP BY o_custkey")
def metric_log_parse(spark, sf_dir):
    lines = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat(F.lit("  Metric::Total="), F.round(F.col("o_totalprice") * 100).cast("long").cast("string")).alias("value"))
    return readers.metric_lines(lines, F.col("o_custkey").cast("string"), F.col("o_orderkey"))


@query(f"{CTE}, u AS (SELECT fd_id, 'Metric::N=' || CAST(CAST(n AS BIGINT) AS VARCHAR) AS value FROM t UNION ALL SELECT fd_id, 'Metric::DomX=' || CAST(CAST(d AS BIGINT) AS VARCHAR) FROM t) SELECT fd_id, value FROM u")
def metric_lines_out(spark, sf_dir):
    return sinks.metric_rows(scored(spark, sf_dir, ["g1"]).select("fd_id", "n", "dom_x"))


@query("SELECT CAST(p_size AS VARCHAR) || unit AS said, seconds FROM (SELECT DISTINCT p_size, CASE p_size % 4 WHEN 0 THEN 'ms' WHEN 1 THEN 's' WHEN 2 THEN 'm' ELSE 'H' END AS unit, CAST(p_size * CASE p_size % 4 WHEN 0 THEN 0.001 WHEN 1 THEN 1.0 WHEN 2 THEN 60.0 ELSE 3600.0 END AS DOUBLE) AS seconds FROM part)")
def parse_durations(spark, sf_dir):
    said = table(spark, sf_dir, "part").selectExpr("concat(cast(p_size as string), CASE p_size % 4 WHEN 0 THEN 'ms' WHEN 1 THEN 's' WHEN 2 THEN 'm' ELSE 'H' END) AS said").distinct()
    return said.select("said", parsing.duration_seconds(F.col("said")).alias("seconds"))


@query()
def generate_syn(spark, sf_dir):
    s = generator.SCENARIOS["zipf_50k"]
    return generator.generate_syn(spark, s, seed=11)


_NOISES = [("zipf", "copy"), ("zipf", "bogus"), ("zipf", "typo"), ("beta", "bogus")]


@query(f"""SELECT dist, n_type, CAST(20000 AS BIGINT) AS rows, CAST(0 AS BIGINT) AS broken_when_clean, CAST(1000 AS BIGINT) AS sites, CAST(CASE WHEN n_type <> 'copy' THEN 1000 END AS BIGINT) AS changed, CAST(CASE WHEN n_type = 'bogus' THEN 1000 END AS BIGINT) AS fresh_values, TRUE AS half_at_most
FROM (VALUES {', '.join(f"('{d}', '{t}')" for d, t in _NOISES)}) AS v(dist, n_type)""")
def generated_noise(spark, sf_dir):
    """What noise does to a generated table: 5 % of 20,000 rows, at most half of any group, new values each once.

    A copied value may be the one that was there, so the changed rows of that kind are not stated.
    """
    out = []
    for dist, n_type in _NOISES:
        s = generator.GeneratorSettings(20_000, 0.3, 2, 0.1, dist_type=dist, lhs_dist_alpha=1.2, lhs_dist_beta=3.0, noise=0.05, n_type=n_type)
        clean = generator.generate_clean(spark, s, 3)
        broken = clean.groupBy(*s.lhs_columns).agg(F.count_distinct("rhs").alias("n")).agg(F.sum((F.col("n") > 1).cast("long")).alias("broken_when_clean"))
        sites = generator.noise_sites(clean, s, 3, bucket_rows=3000).select("row_id", F.lit(1).alias("site"))
        noisy = generator.add_noise(clean, s, 3).select("row_id", F.col("rhs").cast("string").alias("new"))
        both = clean.join(noisy, "row_id").join(sites, "row_id", "left")
        moved = F.when(F.col("new") != F.col("rhs").cast("string"), F.col("new"))
        groups = both.groupBy(*s.lhs_columns).agg(F.count(F.lit(1)).alias("rows"), F.count("site").alias("sites"), F.count(moved).alias("changed"))
        sums = groups.agg(F.sum("rows").alias("rows"), F.sum("sites").alias("sites"), F.sum("changed").alias("changed"), F.min(F.col("sites") * 2 <= F.col("rows")).alias("half_at_most"))
        fresh = both.agg(F.count_distinct(moved).alias("fresh_values"))
        said = sums.join(F.broadcast(broken)).join(F.broadcast(fresh))
        known = {"changed": n_type != "copy", "fresh_values": n_type == "bogus"}
        numbers = [F.when(F.lit(known.get(c, True)), F.col(c)).alias(c) for c in ("rows", "broken_when_clean", "sites", "changed", "fresh_values")]
        out.append(said.select(F.lit(dist).alias("dist"), F.lit(n_type).alias("n_type"), *numbers, "half_at_most"))
    return _union(out)


@query("SELECT * FROM (VALUES ('10000/3000/3000', 0.0000353570978), ('60000/12000/12000', 0.0000076951432)) AS t(fd_id, expected_mi)".replace("SELECT *", "SELECT fd_id, CAST(expected_mi AS DOUBLE) * 1e6 AS micro_bits"))
def expected_mi_large_groups(spark, sf_dir):
    """Pairs whose direct recurrence underflows."""
    cases = [("10000/3000/3000", 10_000, 3_000, 3_000), ("60000/12000/12000", 60_000, 12_000, 12_000)]
    hist = spark.createDataFrame([(i, side, c, 1) for i, _, a, b in cases for side, c in (("x", a), ("y", b))], "fd_id string, side string, count long, weight long")
    n = spark.createDataFrame([(i, n) for i, n, _, _ in cases], "fd_id string, n long")
    return information.expected_mi(hist, n).select("fd_id", (F.round("expected_mi", 13) * 1e6).alias("micro_bits"))


# --- files: what is written is read back ----------------------------------------------------------


def _folder(spark) -> str:
    """A new folder in the storage that driver and executors share; only in one process may it be a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="depscope-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


_NOTE = "c_name || chr(10) || '\"' || c_mktsegment || '\", ' || c_nationkey"


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, {_NOTE} AS note, '' AS empty, c_mktsegment FROM customer")
def csv_text_round_trip(spark, sf_dir):
    """Quoted line breaks, quotes, separators and empty fields."""
    path = _folder(spark)
    note = F.concat("c_name", F.lit('\n"'), "c_mktsegment", F.lit('", '), F.col("c_nationkey").cast("string"))
    sinks.write_csv(table(spark, sf_dir, "customer").select("c_custkey", note.alias("note"), F.lit("").alias("empty"), "c_mktsegment"), path)
    return readers.read_csv_text(spark, path)


@query("SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size, p_retailprice, p_size > 25 AS large, CASE WHEN p_size % 7 > 0 THEN p_brand END AS brand FROM part")
def csv_typed_round_trip(spark, sf_dir):
    """Types from values: whole numbers, fractions, truth values, texts with missing values."""
    path = _folder(spark)
    part = table(spark, sf_dir, "part")
    brand = F.when(F.col("p_size") % 7 > 0, F.col("p_brand")).otherwise("NA")
    sinks.write_csv(part.select("p_partkey", "p_name", "p_size", "p_retailprice", (F.col("p_size") > 25).alias("large"), brand.alias("brand")), path)
    return readers.read_csv_typed(spark, path)


@query(" UNION ALL ".join(f"SELECT '{'|'.join(lhs)}' AS lhs, '{rhs}' AS rhs" for _, lhs, rhs in DEPENDENCIES))
def fd_file_round_trip(spark, sf_dir):
    """Dependency lines between comments and lines that are none."""
    path = _folder(spark)
    lines = ["# dependencies", "", "not one"] + [f"([{', '.join(chr(34) + c + chr(34) for c in lhs)}], {chr(34)}{rhs}{chr(34)})" for _, lhs, rhs in DEPENDENCIES]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    return readers.fd_lines(spark.read.text(path)).select(F.array_join("lhs", "|").alias("lhs"), "rhs")


@query("SELECT CAST(o_orderkey AS BIGINT) AS row_id FROM orders WHERE o_orderkey % 3 = 0")
def violation_list_rows(spark, sf_dir):
    """Row numbers out of texts such as 3,17, one text for each customer."""
    some = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").groupBy("o_custkey").agg(F.array_join(F.collect_list(F.col("o_orderkey").cast("string")), ",").alias("listed"))
    return readers.violation_rows(some, "listed").select(F.col("row_id").cast("long").alias("row_id"))


@query(f"""{CTE} SELECT 'RESULT_JSON: {{"fd_id":"' || fd_id || '","n":' || CAST(CAST(n AS BIGINT) AS VARCHAR) || ',"dom_x":' || CAST(CAST(d AS BIGINT) AS VARCHAR) || '}}' AS value FROM t""")
def json_lines_out(spark, sf_dir):
    return sinks.json_rows(scored(spark, sf_dir, ["g1"]).select("fd_id", "n", "dom_x"))
