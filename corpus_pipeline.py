"""From raw documents to token ids: five stages, each one of the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the docs of the next one. All but the last return the columns of documents, with the values
that came in, whatever their names. Texts are read whole. Null ids, texts and sources, repeated ids and empty tables are
allowed in every stage; what becomes of them is stated with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depscope.llm import bpe, exact_dedup, mixing, near_copies, toxicity
from depscope.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn toxicity from the labels and drop documents with a probability of 0.5 or more.

    Null and empty texts stay, since nothing in them is toxic; without labels of both kinds the probability is a
    constant: 0.5, or the label that there is."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model, threshold=0.5)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each text. Null is the empty text; a null doc_id stays only in a text without others; an id
    that stays does so once."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of documents that similarities of five-word shingles (Jaccard,
    0.8 or more) connect, among those that SimHash fingerprints make candidates. Texts without words stay."""
    return near_copies.drop_near_copies(docs, words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents none, one or two times, so that sources meet their targets. A null source is one; texts without words
    count nothing and stay once if their source has no others."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of the text decoded from them. Null is the empty text."""
    import public_tokenizers

    out = bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Learned scores, fingerprints and byte-level BPE have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
