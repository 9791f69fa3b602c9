"""Helpers shared by the corpus operators: shared storage, table access, text expressions."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once per Spark application."""
    context = spark.sparkContext
    if getattr(context, "_depscope_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(os.path.realpath(tempfile.mkdtemp(prefix="depscope-"))) / "depscope.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(to))
    context._depscope_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the storage that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and driver and executors are
    one process (local tests), a temporary folder stands in for it; elsewhere it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="depscope-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` as a table in shared storage: the lineage ends here, and a lost executor costs a read."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in shared storage, whatever file system it is on."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def normalised(text: Column) -> Column:
    """``text`` with every run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE_CLASS, " ")


def word_count(text: Column) -> Column:
    """Number of maximal runs without white space; null has none."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD_CLASS)).cast("long")


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) with 53 random bits, fixed by the values alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def held_out(id_col: str) -> Column:
    """Whether a document belongs to the fifth that nothing is learned from."""
    rest = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5
    return F.coalesce(rest == 0, F.lit(False))


def hash_sample(df: DataFrame, k: int, n: int, *key: str) -> DataFrame:
    """k of the n rows of ``df``, those first by a hash of ``key``.

    Rows beyond a threshold with room to spare are filtered where they are, so that not every task
    sends k rows to be sorted.
    """
    place = unit_hash(F.lit("sample"), *[F.col(c) for c in key])
    share = 1.0 if n <= 2 * k else 1.5 * k / n + 200 / n
    return df.filter(place < share).orderBy(place, *key).limit(k)


def sampled_labels(labels: DataFrame, label_col: str, id_col: str, most: dict[int, int]) -> DataFrame:
    """(__id, __label) of at most most[label] documents of each label, the first by a hash of their id.

    Documents of the held-out fifth, without a label or with different labels are left out.
    """
    known = labels.filter(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__label"), F.max(label_col).alias("__other"))
    known = known.filter("__label = __other").select("__id", "__label")
    there = {r["__label"]: r["n"] for r in known.filter(F.col("__label").isin(*most)).groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [hash_sample(known.filter(F.col("__label") == k), n, there.get(k, 0), "__id") for k, n in most.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def rows_of(docs: DataFrame, id_col: str, text_col: str, found: DataFrame, stays: Column) -> DataFrame:
    """The rows of ``docs`` whose id stays, each id once.

    ``found`` has a row (id) for every row of docs, with the columns that ``stays`` needs. Rows of an id that
    stays are reduced to one, the first by text, only where ids repeat at all.
    """
    kept = found.withColumn("__stays", stays).groupBy("id").agg(F.max("__stays").alias("stays"), F.count(F.lit(1)).alias("rows"))
    key = free_name(docs, "__id")
    kept = written(kept.filter("not stays or rows > 1").select(F.col("id").alias(key), F.col("stays").alias(free_name(docs, "__stays"))))
    match = F.col(id_col).eqNullSafe(F.col(key))
    out = docs.join(kept, match, "left_anti").select(*docs.columns)
    repeated = kept.filter(F.col(kept.columns[1]))
    if repeated.limit(1).count():
        first = F.min_by(F.struct(*docs.columns), F.struct(F.col(text_col).isNull(), F.col(text_col), F.xxhash64(*docs.columns)))
        some = docs.join(repeated, match, "left_semi").groupBy(F.col(id_col).alias(key)).agg(first.alias("__row"))
        out = out.unionByName(some.select("__row.*"))
    return out
