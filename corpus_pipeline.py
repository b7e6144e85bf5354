"""A training corpus from documents, in stages that each read what the last one wrote.

Toxic documents go; one document of each group of near copies stays; personal
data is replaced; sources are mixed to their target weights, by repeating whole
documents; what is left is encoded. All stages but the last return the columns
of documents. Every stage works on all rows of its input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import bpe, minhash, mixing, pii, toxicity
from quadrille.plans.lineage import cut
from quadrille.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs.select(*COLUMNS), labels)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.keep_one(docs.select(*COLUMNS), minhash.MinMax(shingle=5, percent=80))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat(mixing.mix(docs.select(*COLUMNS)), list(COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of every row, and whether the ids, decoded as a stream, give the row's text."""
    ship(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("doc_id", "source"), check=True)


STAGES = [
    ("toxicity", remove_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("pii", redact),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: The learned grammar and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
