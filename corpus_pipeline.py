"""From raw documents to token ids: quality, near duplicates, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from iotrail.llm import bpe, hyperminhash, mixing, quality
from iotrail.session import pin

#: Rows of an Arrow batch. Texts can be long, and a batch stands in the JVM and in a Python worker at the same time.
BATCH_ROWS = 1000


def _batches(spark: SparkSession) -> None:
    """Sets the size of Arrow batches for the session, as stages are run after they return."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, takes for good. Empty texts and rows without id are judged like all others."""
    _batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.fit(docs, labels))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on shingles of five words."""
    _batches(spark)
    return hyperminhash.one_of_each(docs, width=5, percent=80)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    return mixing.mix(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, texts included, with the token ids of their texts (``ids``), and the digests of ids and decoded text."""
    _batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.round_trip(docs, path, ids="ids")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("mixing_to_weights", mixing_to_weights),
    ("bpe_encoding", bpe_encoding),
]

#: Trees, sketches and merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = pin(docs)
    return docs
