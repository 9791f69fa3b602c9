"""Exact deduplication that no hot text can slow down: combine locally, by salt, then globally.

Three combining stages, each on (digest, whole text), never on the digest alone:

1. the partial aggregate inside every map task leaves one row per text and task;
2. those rows meet by (digest, text, salt), the salt being that of the map task, so that a text
   with copies in every one of a million tasks still reaches several reducers;
3. the salt winners, at most ``salts`` rows a text, meet by digest.

What is left is a thin table digest -> (smallest id, copies, number of different texts). As long
as a digest stands for one text only, which stage 3 has established by comparing the texts, the
documents can find their group by digest without moving their text again. Digests that stand
for several texts, if there are any, are resolved by joining on the text itself.

The documents of hot groups (at least one row in ``hot_share``; so there are at most
``hot_share`` such groups, whatever the input) find theirs in a broadcast table; all others are
joined by digest, where no key has more than that share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depscope.llm.common import normalised, rows_of, written


def sha256_digest(text: Column) -> Column:
    """Binary SHA-256 of the UTF-8 text."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    text = normalised(F.col(text_col))
    return docs.select(F.col(id_col).alias("id"), text.alias("body")).withColumn("digest", digest(F.col("body")))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest=sha256_digest, salts: int = 16) -> DataFrame:
    """One row per different normalised text: digest, body, keep_id (smallest id), group_size.

    Null texts count as empty; null ids never win against others; an empty table gives no rows.
    """
    salted = (
        _keyed(docs, id_col, text_col, digest)
        .withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "body", "salt")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return salted.repartition("digest").groupBy("digest", "body").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest=sha256_digest, salts: int = 16, hot_share: int = 1000) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256 added, dropped rows included.

    Texts are equal when they are identical after every run of ASCII white space is replaced by
    one space. Of equal texts the row with the smallest id stays. Null text counts as empty. A
    null id stays only where its whole group has null ids. Rows that repeat an id are one
    document: they get the same decision. Input columns keep their names, except that a column
    named like an added one is replaced.
    """
    from pyspark.sql import Window

    groups = duplicate_groups(docs, id_col, text_col, digest=digest, salts=salts)
    thin = written(
        groups.select("digest", "keep_id", "group_size", F.count(F.lit(1)).over(Window.partitionBy("digest")).alias("texts"))
    )
    total, mixed = thin.agg(F.sum("group_size"), F.sum(F.when(F.col("texts") > 1, 1).otherwise(0))).first()
    own = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    # Columns for own use begin with two underscores; input columns that do are called otherwise meanwhile.
    hidden = {c: f"in{c}" for c in own.columns if c.startswith("__")}
    names, own = own.columns, own.withColumnsRenamed(hidden)
    id_col, text_col = hidden.get(id_col, id_col), hidden.get(text_col, text_col)
    body = normalised(F.col(text_col))
    keyed = own.withColumn("__body", body).withColumn("__digest", digest(F.col("__body")))
    sha = F.lower(F.hex("__digest")) if digest is sha256_digest else F.sha2(F.col("__body").cast("binary"), 256)
    keyed = keyed.withColumn("__sha", sha)
    if not mixed:
        out = _by_digest(keyed.drop("__body"), thin, id_col, total or 0, hot_share)
    else:
        several = thin.filter("texts > 1").select(F.col("digest").alias("__digest")).distinct()
        plain = _by_digest(keyed.join(several, "__digest", "left_anti").drop("__body"), thin.filter("texts = 1"), id_col, total, hot_share)
        whole = groups.select(F.col("digest").alias("__digest"), F.col("body").alias("__body"), F.col("keep_id").alias("__keep"), F.col("group_size").alias("__size"))
        out = plain.unionByName(keyed.join(several, "__digest", "left_semi").join(whole, ["__digest", "__body"]).drop("__body", "__digest"))
    return out.select(
        *[F.col(f"`{hidden.get(c, c)}`").alias(c) for c in names],
        F.col("__keep").alias("keep_id"),
        F.col("__size").alias("group_size"),
        F.col(id_col).eqNullSafe(F.col("__keep")).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def _by_digest(keyed: DataFrame, thin: DataFrame, id_col: str, total: int, hot_share: int) -> DataFrame:
    """Give each row its group's __keep and __size by digest. Hot groups: total rows / hot_share at least."""
    is_hot = F.col("group_size") * hot_share >= F.lit(total)
    is_hot &= F.col("group_size") > 1
    hot = thin.filter(is_hot).select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__hot_keep"), F.col("group_size").alias("__hot_size"))
    rest = thin.filter(~is_hot).select(F.col("digest").alias("__key"), F.col("keep_id").alias("__keep"), F.col("group_size").alias("__size"))
    hot_row = F.col("__hot_size").isNotNull()
    # Rows that have their group already are dealt by their id, to a key that no digest has.
    spread = F.concat(F.lit("hot").cast("binary"), F.xxhash64(id_col).cast("string").cast("binary"))
    return (
        keyed.join(F.broadcast(hot), "__digest", "left")
        .withColumn("__key", F.when(hot_row, spread).otherwise(F.col("__digest")))
        .drop("__digest")
        .join(rest, "__key", "left")
        .withColumn("__keep", F.when(hot_row, F.col("__hot_keep")).otherwise(F.col("__keep")))
        .withColumn("__size", F.when(hot_row, F.col("__hot_size")).otherwise(F.col("__size")))
        .drop("__key", "__hot_keep", "__hot_size")
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``; an id that stays does so in one row.

    Other cases as in ``exact_dedup``.
    """
    found = exact_dedup(docs.select(id_col, text_col), id_col, text_col, **options)
    found = written(found.select(F.col(id_col).alias("id"), "kept"))
    return rows_of(docs, id_col, text_col, found, F.col("kept"))
