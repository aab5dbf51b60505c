"""A corpus from documents to token ids, as stages that each write a table.

Every stage takes what its predecessor kept. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import exact, jaccard, mixing, pieces, quality
from lexweave.llm.common import held_out, table
from lexweave.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, taught by the labelled ones, gives a score of 0.5 or more."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    net = quality.learn(docs, labels)
    scored = quality.score(docs.select(*COLUMNS), net, keep=tuple(COLUMNS))
    return scored.where(F.col("score") >= 0.5).select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id."""
    return exact.drop_copies(docs).select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingle sets, the one with the smallest id."""
    return jaccard.one_of_each(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by weight: each document with the text that the mix takes of it."""
    return mixing.mixed_texts(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and whether they decode to it."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode(docs, model, keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", sentencepiece),
]

# The classifier is learnt and the blocks are drawn by a seed: no SQL says that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
