"""The corpus pipeline: filters, removes repeats and packs the documents of a training corpus.

Every stage takes the documents its predecessor kept and, but for the last, returns
documents with the columns it was given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from bindery.llm.encoding import vocabulary
from bindery.llm.exact_dedup import drop_copies
from bindery.llm.packing import pack_documents
from bindery.llm.simhash import drop_near_copies
from bindery.llm.substring_dedup import cut_repeats
from bindery.llm.toxicity import drop_toxic
from bindery.session import discard, shared_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the models learn from the labelled ones outside the held-out fold."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for the case of A-Z) the document with the largest id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of fingerprints 4 or fewer bits apart the document with the smallest id stays."""
    return drop_near_copies(docs, shingle=4, bits=4)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds are cut out of the texts."""
    return cut_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed sequence, with its ids (little-endian unsigned 32-bit)."""
    return pack_documents(docs, vocabulary())


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

# Models, hashes and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    previous = None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if previous:
            discard(spark, previous)
        previous = path
    return docs
