"""Readers: CSV with both meanings of an empty field, dependency files, row lists, logs, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depscope.functions.parsing import row_list, value_kind
from depscope.spec import FDSpec


def read_csv_text(spark: SparkSession, path: str, sep: str = ",", *, quoted_newlines: bool = True) -> DataFrame:
    """All columns as text. An empty field is an empty text; a field missing from a short row is null;
    fields beyond the header are dropped. Quotes are doubled inside quotes.

    With ``quoted_newlines`` a field in quotes may hold line breaks, and a task reads whole files; without, large files
    are split among tasks.
    """
    # As text, since a header read as a row keeps its quotes' meaning and needs no inference.
    reader = lambda: spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", quoted_newlines)
    header = reader().csv(path).columns
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in header], T.StructField("__bad", T.StringType())])
    # The columns are filled by position, and a row of another length is kept whole beside them.
    df = reader().schema(schema).option("enforceSchema", True).option("columnNameOfCorruptRecord", "__bad").csv(path)
    # Which fields a short row has shows in its number of separators outside quotes.
    outside = F.regexp_replace(F.col("__bad"), '"(?:[^"]|"")*"', "")
    fields = F.size(F.split(outside, "\\Q" + sep + "\\E", -1))
    present = lambda i: F.col("__bad").isNull() | (fields > i)
    return df.select(*[F.when(F.col(f"`{c}`").isNull() & present(i), F.lit("")).otherwise(F.col(f"`{c}`")).alias(c) for i, c in enumerate(header)])


def read_csv_typed(spark: SparkSession, path: str, sep: str = ",", *, quoted_newlines: bool = True) -> DataFrame:
    """Column types from the values; empty and missing fields and the usual marks of missing values are null."""
    # Texts that stand for a missing value.
    marks = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
    text = read_csv_text(spark, path, sep, quoted_newlines=quoted_newlines)
    clean = text.select(*[F.when(~F.col(f"`{c}`").isin(marks), F.col(f"`{c}`")).alias(c) for c in text.columns])
    kinds = clean.agg(*[F.collect_set(F.when(F.col(f"`{c}`").isNotNull(), value_kind(F.col(f"`{c}`")))).alias(c) for c in clean.columns]).first() if clean.columns else []
    cast = {frozenset(["int"]): "long", frozenset(["float"]): "double", frozenset(["int", "float"]): "double", frozenset(["bool"]): "boolean"}
    return clean.select(*[F.trim(F.col(f"`{c}`")).cast(cast[frozenset(k)]).alias(c) if frozenset(k) in cast else F.col(f"`{c}`") for c, k in zip(clean.columns, kinds, strict=True)])


def read_uint_csv(spark: SparkSession, path: str) -> DataFrame:
    """Plain CSV without quotes of unsigned numbers: blanks ignored, what is no number is 0, short rows filled
    with 0, blank lines skipped, unnamed columns col0, col1, ..."""
    lines = spark.read.text(path).withColumn("row", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    first = lines.orderBy("row").first()
    names = [n.strip() or f"col{i}" for i, n in enumerate(first["value"].split(","))] if first else []
    parts = F.split("value", ",")
    cells = [F.coalesce(F.regexp_replace(F.get(parts, F.lit(i)), r"\s", "").try_cast("long"), F.lit(0)).alias(n) for i, n in enumerate(names)]
    return lines.filter(F.col("row") != F.lit(first["row"] if first else -1)).select(*cells)


def fd_lines(lines: DataFrame) -> DataFrame:
    """(lhs, rhs) from lines such as ``(["a", "b"], "c")``; blank lines, comments and others are skipped."""
    text = F.trim("value")
    ok = text.rlike(r'^\(\s*\[\s*("[^"]+"\s*(,\s*"[^"]+"\s*)*)\]\s*,\s*"[^"]+"\s*\)$')
    inner = F.regexp_extract(text, r"\[(.*)\]", 1)
    names = F.transform(F.regexp_extract_all(inner, F.lit('"([^"]+)"'), 1), F.trim)
    return lines.filter(~text.startswith("#") & ok).select(names.alias("lhs"), F.trim(F.regexp_extract(text, r'\]\s*,\s*"([^"]+)"', 1)).alias("rhs"))


def read_fds(spark: SparkSession, path: str) -> list[FDSpec]:
    """The dependencies of a file (a short one: the list is held by the driver), in its order."""
    return [FDSpec(tuple(r["lhs"]), r["rhs"]) for r in fd_lines(spark.read.text(path)).collect()]


def split_lhs(text: Column) -> Column:
    """Left-hand columns of ``a|b|c``."""
    return F.transform(F.split(text, r"\|"), F.trim)


def violation_rows(lists: DataFrame, column: str) -> DataFrame:
    """(row_id): the row numbers of texts such as ``3,17``."""
    return lists.select(F.explode(row_list(F.col(column))).alias("row_id"))


def read_ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    """(case_id, left_col, right_col, sample_type, violation_rows) of all ``<case>/ground_truth.csv``."""
    schema = "left_col string, right_col string, sample_type string, violation_rows string"
    raw = spark.read.option("header", True).option("enforceSchema", False).option("escape", '"').schema(schema).csv(f"{folder}/*/ground_truth.csv")
    case = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/ground_truth\.csv$", 1)
    return raw.select(case.alias("case_id"), "left_col", "right_col", "sample_type", row_list(F.col("violation_rows")).alias("violation_rows"))


def metric_lines(lines: DataFrame, run: Column, order: Column) -> DataFrame:
    """(run_id, name, value, kind) from lines ``Metric::Name=value``; the last of a name counts."""
    pattern = r"^Metric::([A-Za-z][A-Za-z0-9_.-]*)=(.*)$"
    line = F.trim("value")
    rows = lines.filter(line.rlike(pattern)).select(run.alias("run_id"), order.alias("at"), F.regexp_extract(line, pattern, 1).alias("name"), F.trim(F.regexp_extract(line, pattern, 2)).alias("value"))
    last = rows.groupBy("run_id", "name").agg(F.max_by("value", "at").alias("value"))
    return last.withColumn("kind", value_kind(F.col("value")))


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """One row per readable ``runs/*/result.json``, tags and metrics as maps; unreadable files are skipped."""
    schema = (
        "run_id string, experiment string, repetition int, status string, wall_time_ms double, peak_memory_mb double, exit_code int, timeout double, memory_limit long, "
        "started_at_utc string, ended_at_utc string, command array<string>, error string, args string, tags map<string,string>, metrics map<string,string>"
    )
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(f"{folder}/runs/*/result.json")
