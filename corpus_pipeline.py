"""The corpus pipeline: quality, near-duplicates, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet to the shared folder and reads it again as the next one's documents. All stages but
the last return the columns of ``documents``. Nulls, empty texts, ties, repeated rows and
empty tables are treated as the operators' docstrings state. doc_id is taken to name a
document, but repeated rows pass through: of near-duplicates the rows with the smallest
doc_id stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sextant.functions.scratch import discard, durable, passing
from sextant.llm.packing import packing
from sextant.llm.pii import redact
from sextant.llm.quality import good_documents
from sextant.llm.shingle_dedup import shingle_dedup
from sextant.llm.source_mix import mixed_documents

#: SQL can't express these stages; tests hold each against a plain version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney quality classifier keeps; trained on the ``labels`` of ``sf_dir``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return good_documents(docs, labels)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates.

    Candidates come from the SimHash trie join and from minimum hashes, as 64 bits can't
    carry the similarity; all are confirmed. Near-duplicates have a Jaccard similarity of 0.8
    or more by sets of five-word shingles; documents without a doc_id can't be compared and
    stay.
    """
    return shingle_dedup(docs, shingle=5, least=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by its kind."""
    return redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, the last one of a source cut."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed sequences' pieces with their token ids."""
    return packing(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("personal_data", personal_data), ("source_mix", source_mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with passing() as kept:
            docs = durable(stage(spark, docs, sf_dir))
            kept.append(docs)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
