"""Mixing sources to target weights by entropy balancing.

For every source s the rates r of its documents minimise sum(r ln r - r), the relative entropy
to taking every document once, under sum(r * words) = target and r <= cap. The Lagrangian gives
exponentially tilted rates r = min(cap, exp(lambda_s * words / mean words of s)), and lambda_s
maximises a concave dual with one variable per source. Newton's method solves all of them at
once: each iteration is one aggregation over the table (source, words) -> documents, which is
all that the dual depends on, so documents are read once however many iterations there are. A
bracket around each lambda keeps the steps safe where the cap makes the dual piecewise smooth.

Rates become copies by sequential Poisson sampling: every document gets floor(r) copies, and one
more goes to the documents with the smallest u / (r - floor(r)), u a hash of the id, until the
source's target is reached. The cut is found from word sums in fixed buckets of that key, then
exactly inside the one bucket where it lies. One more document, whose size is closest to what is
still missing, completes it. Decisions depend on the document and the source's parameters alone:
reruns agree, and no row is moved to its decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depscope.llm.common import remove, shared_dir, unit_hash, word_count, written

#: Buckets of the sampling key are 1/KEY_STEPS wide; keys of KEY_MAX and more share the last.
KEY_STEPS, KEY_MAX = 1024, 4
#: A parameter table of at most so many sources is broadcast.
BROADCAST_SOURCES = 10_000


def source_targets(sources: DataFrame, *, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Add a target to (source, source_size): weights repeat over the sources by code point, null last.

    The targets share ``share`` times all words by weight; none is above ``cap`` times its source's
    size, and what is cut off there is shared by weight among the others. That is a common level L
    with target = min(cap * size, weight * L), found where sources sorted by cap * size / weight
    stop being full.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("__rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("__rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("__w", w)
    full = (F.col("source_size") * F.lit(float(cap))).alias("__full")
    ranked = ranked.withColumn("__full", full).withColumn("__fill", F.col("__full") / F.col("__w"))
    by_fill = Window.orderBy("__fill", "__rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = (
        ranked.withColumn("__full_before", F.coalesce(F.sum("__full").over(by_fill), F.lit(0.0)))
        .withColumn("__w_left", F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(by_fill), F.lit(0.0)))
        .withColumn("__goal", F.sum("source_size").over(every) * F.lit(float(share)))
    )
    # The level if all sources before this one are full and this and later ones are not.
    ranked = ranked.withColumn("__level", (F.col("__goal") - F.col("__full_before")) / F.col("__w_left"))
    first = F.when(F.col("__fill") >= F.col("__level"), F.struct("__fill", "__rank"))
    level = F.min_by("__level", first).over(every)
    target = F.least(F.col("__full"), F.coalesce(level * F.col("__w"), F.col("__full")))
    return ranked.select(*sources.columns, target.alias("target"))


def solve_tilts(hist: DataFrame, sources: DataFrame, *, cap: float = 2.0, tolerance: float = 1e-9, rounds: int = 60) -> DataFrame:
    """Add lambda to ``sources`` (source, n, source_size, target) from ``hist`` (source, size, n).

    Sources whose target is at the cap or whose size or target is zero need no tilt: their rate is
    constant, and lambda is null.
    """
    spark = hist.sparkSession
    fixed = (F.col("source_size") == 0) | (F.col("target") <= 0) | (F.col("target") >= F.col("source_size") * F.lit(cap * (1 - 1e-12)))
    state = sources.withColumn("lambda", F.when(~fixed, F.lit(0.0))).withColumn("lo", F.lit(None).cast("double")).withColumn("hi", F.lit(None).cast("double")).withColumn("off", F.lit(None).cast("double"))
    root = shared_dir(spark)
    state = written(state, f"{root}/0")
    small = _bounded(state)
    for i in range(1, rounds + 1):
        z = F.col("h.size") * F.col("s.n") / F.col("s.source_size")
        # Past the cap the exponential is not needed; the bound keeps it finite.
        e = F.exp(F.least(F.col("s.lambda") * z, F.lit(50.0)))
        words = F.col("h.size") * F.col("h.n")
        sums = (
            hist.alias("h")
            .join(small(state).alias("s"), F.col("h.source").eqNullSafe(F.col("s.source")) & F.col("s.lambda").isNotNull())
            .groupBy(F.col("s.source").alias("source"))
            .agg(F.sum(words * F.least(e, F.lit(cap))).alias("__g"), F.sum(F.when(e < cap, words * z * e).otherwise(0.0)).alias("__h"))
        )
        gap = F.col("__g") - F.col("target")
        lo = F.when(gap < 0, F.col("lambda")).otherwise(F.col("lo"))
        hi = F.when(gap >= 0, F.col("lambda")).otherwise(F.col("hi"))
        step = F.when(F.col("__h") > 0, F.col("lambda") - gap / F.col("__h"))
        inside = (step > F.coalesce(lo, F.lit(-1e300))) & (step < F.coalesce(hi, F.lit(1e300)))
        safe = F.when(lo.isNull(), hi * 2 - 1).when(hi.isNull(), lo * 2 + 1).otherwise((lo + hi) / 2)
        moved = F.when(inside, step).otherwise(safe)
        done = F.abs(gap) <= F.col("target") * tolerance
        joined = state.join(sums.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")), "left")
        state = written(
            joined.select(
                *sources.columns,
                F.when(F.col("__g").isNull() | done, F.col("lambda")).otherwise(moved).alias("lambda"),
                lo.alias("lo"),
                hi.alias("hi"),
                F.when(F.col("__g").isNotNull(), F.abs(gap) / F.col("target")).alias("off"),
            ),
            f"{root}/{i}",
        )
        worst = state.agg(F.max("off")).first()[0]
        if i > 1:
            remove(spark, f"{root}/{i - 1}")
        if worst is None or worst <= tolerance:
            break
    return state.select(*sources.columns, "lambda")


def _bounded(sources: DataFrame):
    """Broadcast tables with a row a source where their number is known to be small."""
    return F.broadcast if sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else (lambda df: df)


def _rate(size: Column, cap: float) -> Column:
    tilt = F.exp(F.least(F.col("lambda") * size * F.col("n") / F.col("source_size"), F.lit(50.0)))
    constant = F.when(F.col("source_size") == 0, 1.0).when(F.col("target") <= 0, 0.0).otherwise(float(cap))
    return F.when(F.col("lambda").isNull(), constant).otherwise(F.least(tilt, F.lit(float(cap))))


def _parts(df: DataFrame, size: Column, ident: Column, cap: float) -> DataFrame:
    """Add __rate, __whole, __key (null without a fraction) and __bucket."""
    u = unit_hash(F.lit("mix"), ident)
    frac = F.col("__rate") - F.col("__whole")
    df = df.withColumn("__rate", _rate(size, cap)).withColumn("__whole", F.floor("__rate"))
    df = df.withColumn("__key", F.when(frac > 0, u / frac))
    return df.withColumn("__bucket", F.floor(F.least(F.col("__key"), F.lit(float(KEY_MAX))) * KEY_STEPS))


def fit_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Everything that ``apply_mix`` needs, one row per source: source, n, source_size, target, lambda, cut."""
    thin = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))
    hist = written(thin.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = hist.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    fitted = solve_tilts(hist, source_targets(sources, weights=weights, share=share, cap=cap), cap=cap)
    small = _bounded(fitted)

    def with_source(df: DataFrame, params: DataFrame) -> DataFrame:
        p = params.withColumnRenamed("source", "__source")
        return df.join(small(p), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")

    parts = _parts(with_source(thin, fitted), F.col("size"), F.col("id"), cap)
    sums = parts.groupBy("source", "__bucket").agg(F.sum("size").alias("words"), F.sum(F.col("__whole") * F.col("size")).alias("whole"))
    sums = written(sums)
    rest = sums.groupBy("source").agg(F.sum("whole").alias("whole")).withColumnRenamed("source", "__s")
    rest = fitted.join(rest, F.col("source").eqNullSafe(F.col("__s")), "left").select("source", (F.col("target") - F.col("whole")).alias("rest"))
    run = F.sum("words").over(Window.partitionBy("source").orderBy("__bucket"))
    cum = with_source(sums.filter("__bucket is not null").select("source", "__bucket", "words", run.alias("cum")), rest)
    # The first bucket that goes past what is to be had; none: take all.
    cut = cum.filter(F.col("cum") > F.col("rest")).groupBy("source").agg(F.min_by(F.struct(F.col("__bucket").alias("bucket"), (F.col("rest") - F.col("cum") + F.col("words")).alias("left")), "__bucket").alias("cut"))
    fitted = written(_merge(fitted, cut))
    edge = _parts(with_source(thin, fitted), F.col("size"), F.col("id"), cap).filter(F.col("__bucket") == F.col("cut.bucket"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("__key", "id", "size").rowsBetween(Window.unboundedPreceding, 0))
    last = edge.withColumn("__cum", upto).filter(F.col("__cum") <= F.col("cut.left")).groupBy("source").agg(F.max(F.struct("__key", "id", "size")).alias("last"))
    fitted = _merge(fitted, last)
    taken = _parts(with_source(thin, fitted), F.col("size"), F.col("id"), cap).withColumn("__copies", _copies(F.col("id"), F.col("size")))
    got = taken.groupBy("source").agg(F.sum(F.col("__copies") * F.col("size")).alias("got"))
    fitted = written(_merge(fitted, got))
    spare = _parts(with_source(thin, fitted), F.col("size"), F.col("id"), cap).withColumn("__copies", _copies(F.col("id"), F.col("size")))
    miss = F.col("target") - F.col("got")
    spare = spare.filter(F.col("__key").isNotNull() & (F.col("__copies") == F.col("__whole")) & (F.abs(miss - F.col("size")) < miss))
    fill = spare.groupBy("source").agg(F.min(F.struct(F.abs(miss - F.col("size")).alias("off"), F.col("__key").alias("key"), F.col("id"))).alias("fill"))
    return written(_merge(fitted.drop("got"), fill.select("source", F.col("fill.id").alias("fill"))))


def _merge(params: DataFrame, more: DataFrame) -> DataFrame:
    more = more.withColumnRenamed("source", "__s")
    return params.join(more, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")


def _copies(ident: Column, size: Column) -> Column:
    """floor(rate), and one more up to the source's cut."""
    before = F.col("__bucket") < F.col("cut.bucket")
    at = (F.col("__bucket") == F.col("cut.bucket")) & (F.struct(F.col("__key"), ident.alias("id"), size.alias("size")) <= F.col("last"))
    more = F.col("__key").isNotNull() & (F.col("cut").isNull() | before | F.coalesce(at, F.lit(False)))
    return (F.col("__whole") + F.when(more, 1).otherwise(0)).cast("int")


def _decided(docs: DataFrame, params: DataFrame, id_col: str, text_col: str, source_col: str, cap: float) -> DataFrame:
    """(__row, __size, source_size, target, __rate, copies): rows travel as one struct, so that no column can clash."""
    small = _bounded(params)
    p = params.select(F.col("source").alias("__source"), "n", "source_size", "target", "lambda", "cut", "last", F.col("fill").alias("__fill"))
    rows = docs.select(F.struct(*docs.columns).alias("__row"), word_count(F.col(text_col)).alias("__size"), F.col(id_col).alias("__id"), F.col(source_col).alias("__src"))
    rows = rows.join(small(p), F.col("__src").eqNullSafe(F.col("__source")))
    rows = _parts(rows, F.col("__size"), F.col("__id"), cap)
    copies = _copies(F.col("__id"), F.col("__size"))
    filled = F.col("__id").eqNullSafe(F.col("__fill")) & F.col("__fill").isNotNull() & F.col("__key").isNotNull() & (copies == F.col("__whole"))
    return rows.withColumn("copies", copies + F.when(filled, 1).otherwise(0))


def apply_mix(docs: DataFrame, params: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, cap: float = 2.0) -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies added (columns of these names are replaced)."""
    own = [f"__row.{c}" for c in docs.columns if c not in ("size", "source_size", "target", "rate", "copies")]
    rows = _decided(docs, params, id_col, text_col, source_col, cap)
    return rows.select(*own, F.col("__size").alias("size"), "source_size", "target", F.col("__rate").alias("rate"), "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies added.

    Size is the number of words of the whole text, however long. A null text or one without words has size 0 and costs
    nothing; a null source is a source, the last one. Rows that repeat an id with one size share their decision, also
    the one that completes a target. Ties in the sampling key are ordered by id and size. An empty table gives no rows.
    ``cap`` bounds copies and rates and must be whole.
    """
    params = fit_mix(docs, id_col, text_col, source_col, weights=weights, share=share, cap=cap)
    return apply_mix(docs, params, id_col, text_col, source_col, cap=cap)


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The rows of ``docs`` as many times as the mix takes them, with their own columns and values. Cases as in ``mix``."""
    params = fit_mix(docs, id_col, text_col, source_col, weights=weights, share=share, cap=cap)
    rows = _decided(docs, params, id_col, text_col, source_col, cap).filter("copies > 0")
    return rows.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")
