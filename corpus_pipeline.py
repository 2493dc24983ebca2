"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all that its predecessor kept and is written as Parquet before the next one
reads it. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from glyphloom.llm import mixing, packing, quality, secrets, simhash
from glyphloom.llm.common import remove, remove_at_end, scratch, shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and come from sources that aren't rejected."""
    return quality.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group of near-duplicates."""
    return simhash.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their sources' targets ask for."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]
#: SQL can express neither SimHash nor the tokens; the tests hold run() against the rules, components, redaction
#: and token pieces in plain Python, and against what the mix and the packing promise.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again. A stage's own tables go when
    it is written, a stage's output when its successor is, and the last one when the session ends."""
    docs, base = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        if i:
            remove(spark, f"{base}/{i - 1}")
        docs = spark.read.parquet(f"{base}/{i}")
    remove_at_end(spark, base)
    return docs
