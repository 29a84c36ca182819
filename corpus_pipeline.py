"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's documents.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tertulia.llm import entropy_mixing, line_quality, pii_disclosure, simhash_pivots, vector_packing
from tertulia.llm.queries import tokenizer_path
from tertulia.sources.staging import remove, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; failing lines leave the others."""
    return line_quality.keep_clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (fingerprints of three-word shingles, 3 bits apart at most) stays, the smallest doc_id."""
    return simhash_pivots.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are replaced by their kind."""
    return pii_disclosure.sanitise(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return entropy_mixing.mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences, with their token ids."""
    return vector_packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("pii", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

# Fingerprints by XXH64, Newton steps and a tokenizer's ids are beyond SQL; tests hold the run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what stands between them is written to the shared folder.

    The result is read from the last of these tables, so the folder stays until the caller deletes it: all tables but
    the last are removed here, and the last holds documents whose personal data is masked.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    done: list[str] = []
    try:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
            done.append(f"{base}/{name}")
            docs = spark.read.parquet(done[-1])
    finally:
        for path in done[: len(STAGES) - 2]:
            remove(spark, path)
    return STAGES[-1][1](spark, docs, sf_dir)
