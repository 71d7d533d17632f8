"""Corpus preparation in five stages over the documents table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fairlead.llm import bpe, decontam, pii, quality, simhash
from fairlead.llm.queries import table, vocabulary
from fairlead.llm.textkit import by_place
from fairlead.operators.components import forget, shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, failing lines of the others too."""
    return quality.quality_filter(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind."""
    return pii.redact(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, decoded): token ids and the text they decode to, a row for each row; other columns end here."""
    return bpe.encode(docs, vocabulary())


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("BPE encoding and decoding", encoding_stage),
]

#: SQL can express neither SimHash classes nor the tokenizer; tests hold run() against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents: (doc_id, ids, decoded).

    Each result is written in the shared folder, its columns by their places so that
    clashing names do no harm, and read again; the result before it is then deleted.
    The last one stays, as the returned rows are read from it, and is the caller's to
    delete (``inputFiles()`` tells where it is).

    Null ids and ids that repeat pass through: of rows that share an id those with
    different fingerprints all stay, so an id may then name several rows.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        names = docs.columns
        by_place(docs).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}").toDF(*names)
        if k:
            forget(spark, f"{folder}/{k - 1}")
    return docs
