"""A training corpus from ``documents``: five stages, each one operator.

Every stage reads the table its predecessor wrote and works on all of it. A lost executor
costs the tasks it ran: stages end in a written table, and what an operator reads twice it
keeps in the shared folder of spark.checkpoint.dir.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plyframe.llm import decontaminate, langid, linededup, mixing, simhash
from plyframe.llm.common import shared_dir, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is undetermined or scored too low."""
    return langid.keep_identified(docs)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes repeated passages of lines after their first occurrence, and documents of
    which nothing is left."""
    return linededup.without_repeats(docs)


def deduplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    return simhash.keep_one(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens and the rate at which a document enters the mixture; drops documents
    that the targets leave out."""
    return mixing.mixture(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", deduplicate_lines),
    ("simhash_dedup", deduplicate_documents),
    ("decontaminate", decontaminate_documents),
    ("mix", mix_domains),
]

#: stage 1 is a trained network, so no SQL gives these rows; the tests use brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
