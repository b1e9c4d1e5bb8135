"""Corpus pipeline: five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written
as Parquet into the shared checkpoint folder and read again as the next stage's
``docs``, so a lost executor or driver costs one stage at most.  A stage's copy is
deleted once the next one is written.  The first four return the columns of
``documents`` without the rows they reject; the last returns the packing of what
is left.

Every stage takes empty tables, nulls, repeated rows and further columns (also
with the names that the operators use inside); what becomes of them is said where
the operators are defined.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tastemap.llm.common import delete_folder, prepare, table
from tastemap.llm.decontaminate import drop_contaminated
from tastemap.llm.exact_dedup import drop_exact_copies
from tastemap.llm.language_id import keep_identified
from tastemap.llm.near_dedup import drop_near_copies
from tastemap.llm.packing import pack_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go; null and empty texts among them."""
    prepare(spark)
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the longest as written, then the least ``doc_id`` (nulls last).

    Null and blank texts are one group."""
    prepare(spark)
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (five words, 80 percent) stays: the one with the least
    ``doc_id`` (nulls last).  Null and blank texts are linked with nothing and stay."""
    prepare(spark)
    return drop_near_copies(docs, words=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's passages go; null and empty texts stay."""
    prepare(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their bins; a document without words is one row without a bin."""
    prepare(spark)
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Identification, links and packing are no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all of ``documents``."""
    prepare(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            delete_folder(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
