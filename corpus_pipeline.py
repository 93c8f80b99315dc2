"""Corpus pipeline: toxicity, SimHash near-dedup, secret scans, mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's docs.  All
but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.llm import mixing, packing, secrets, simhash, toxicity
from chalkline.llm.common import discard, documents, scratch, shared_dir, table


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now, where the table has such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst segment the classifier calls toxic go."""
    return toxicity.without_toxic(docs, toxicity.toxicity_model(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return _sized(secrets.redact_secrets(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents, so that sources have their target weights."""
    return _sized(mixing.mixed_documents(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048."""
    return packing.packed_sequences(docs)


STAGES = [("toxicity", drop_toxic), ("simhash_dedup", keep_one_of_each), ("secret_scan", redact), ("mixing", mix), ("packing", pack)]

#: The classifier and the tokenizer are beyond SQL; tests hold run() against a plain Python version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; a stage's tables go once the next one is written."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
