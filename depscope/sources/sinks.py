"""Writers: metric lines, JSON records, flat results, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a flat result that come first (fixed values).
CORE_COLUMNS = ["run_id", "experiment", "repetition", "status", "wall_time_ms", "peak_memory_mb", "exit_code", "timeout", "memory_limit", "started_at_utc", "ended_at_utc", "command", "error"]


def metric_rows(scored: DataFrame, key: str = "fd_id") -> DataFrame:
    """(fd_id, value): each measure of a result as a line ``Metric::Name=value``, nulls left out."""
    names = [c for c in scored.columns if c != key]
    camel = lambda c: "".join(p[:1].upper() + p[1:] for p in c.split("_"))
    lines = [F.concat(F.lit(f"Metric::{camel(c)}="), F.col(c).cast("string")) for c in names]
    return scored.select(key, F.explode(F.array(*lines)).alias("value")).filter("value is not null")


def json_rows(scored: DataFrame) -> DataFrame:
    """(value): each result as one line ``RESULT_JSON: {...}``."""
    return scored.select(F.concat(F.lit("RESULT_JSON: "), F.to_json(F.struct(*scored.columns))).alias("value"))


def flat_results(results: DataFrame) -> DataFrame:
    """Runs with their tags, arguments and metrics as columns: the core columns, then all others by name.

    Which columns there are is read from the data, once; names that collide get ``metric_``.
    """
    keys = lambda c: sorted(r[0] for r in results.select(F.explode(F.map_keys(c))).distinct().collect()) if c in results.columns else []
    core = [c for c in CORE_COLUMNS if c in results.columns]
    extra = {f"tag_{k}": F.col("tags")[k] for k in keys("tags")}
    if "args" in results.columns and dict(results.dtypes)["args"] == "string":
        names = sorted(r[0] for r in results.select(F.explode(F.json_object_keys("args"))).distinct().collect())
        extra |= {f"arg_{k}": F.get_json_object("args", f"$['{k}']") for k in names}
        if results.filter("json_object_keys(args) is null and args is not null").limit(1).count():
            extra["arguments"] = F.when(F.json_object_keys("args").isNull(), F.col("args"))
    taken = {*core, *extra}
    for k in keys("metrics"):
        extra[f"metric_{k}" if k in taken else k] = F.col("metrics")[k]
    return results.select(*[F.array_join(c, " ").alias(c) if dict(results.dtypes)[c].startswith("array") else F.col(c) for c in core], *[extra[c].alias(c) for c in sorted(extra)])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of CSV files with a header, quotes doubled inside quotes; ``ignore`` keeps what is there."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; the commit of the whole job is atomic."""
    df.write.mode(mode).json(path)


def write_metric_lines(scored: DataFrame, path: str) -> None:
    metric_rows(scored).select("value").write.mode("overwrite").text(path)
