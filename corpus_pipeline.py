"""From documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written and read again as the
next one's documents. All stages but the last return documents with the columns they came with.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordercast.llm import decontamination, jaccard_join, packing, perplexity, toxicity
from ordercast.llm.common import documents, fold, prepare, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score 0.3 or more; labels of the held-out quarter are not learned from."""
    labels = documents(spark, sf_dir, "labels")
    return toxicity.keep_harmless(docs, labels.where(fold(F.col("doc_id"), 4) != 2), threshold=0.3)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that fail the word rules or lie outside of their language's perplexity band."""
    return perplexity.keep(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles with a Jaccard similarity of 0.8 or more link."""
    return jaccard_join.without_copies(docs, width=5, rule=jaccard_join.Threshold(num=80, den=100))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that contain half of a benchmark item or more, in whatever order."""
    return decontamination.clean(docs, documents(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_copies),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack_sequences),
]

#: A learned score and the packing's search are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = documents(spark, sf_dir)
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
