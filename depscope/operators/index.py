"""Where values occur: row lists, bitmaps, co-occurring values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_rows(df: DataFrame, column: str, id_col: str) -> DataFrame:
    """(value, bucket, rows): ids of the rows with each value, ascending, in pieces of one bucket of 32,768 ids.

    A frequent value has many pieces, so that no row grows without bound.
    """
    rows = df.select(F.col(column).cast("string").alias("value"), F.col(id_col).cast("long").alias("id"))
    return rows.groupBy("value", F.floor(F.col("id") / 32768).alias("bucket")).agg(F.sort_array(F.collect_list("id")).alias("rows"))


def bitmap_index(df: DataFrame, column: str, id_col: str) -> DataFrame:
    """(value, bucket, bitmap): ids from 0 as bitmaps of fixed size, bit i of bucket b for id
    (b - 1) * 32,768 + i. ``bitmap_cardinality`` and ``bitmap_lookup`` read it."""
    rows = df.select(F.col(column).cast("string").alias("value"), (F.col(id_col).cast("long") + 1).alias("id"))
    return rows.groupBy("value", F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bitmap"))


def bitmap_cardinality(index: DataFrame) -> DataFrame:
    """(value, rows): number of rows with each value."""
    return index.groupBy("value").agg(F.sum(F.bitmap_count("bitmap")).alias("rows"))


def bitmap_lookup(index: DataFrame, value: str) -> DataFrame:
    """(id): rows with a value."""
    bits = index.filter(F.col("value").eqNullSafe(F.lit(value))).select("bucket", F.explode(F.sequence(F.lit(0), F.lit(32767))).alias("bit"), "bitmap")
    octet = F.conv(F.hex(F.expr("substring(bitmap, cast(floor(bit / 8) as int) + 1, 1)")), 16, 10).cast("int")
    on = octet.bitwiseAND(F.pow(F.lit(2), F.col("bit") % 8).cast("int")) != 0
    return bits.filter(on).select(((F.col("bucket") - 1) * 32768 + F.col("bit")).alias("id"))


def cooccurrence(df: DataFrame, column: str, others: Sequence[str]) -> DataFrame:
    """(value, other_column, other_value): each pair once; a set as rows, whatever its size."""
    cells = [F.struct(F.lit(c).alias("other_column"), F.col(f"`{c}`").cast("string").alias("other_value")) for c in others]
    rows = df.select(F.col(column).cast("string").alias("value"), F.explode(F.array(*cells)).alias("cell")).select("value", "cell.*")
    return rows.filter("value is not null and other_value is not null").distinct()
