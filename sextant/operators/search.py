"""Retrieval as a whole: mask, find entities, search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.functions.scratch import durable, spread
from sextant.operators.entities import find_medications
from sextant.operators.masking import mask_pii
from sextant.operators.retrieval import retrieve


def routed(questions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(question_id, vector, only) of the questions (question_id, text, vector) that are searched.

    Blank ones and those that name nothing of the catalogue aren't; one that names a single
    entry is searched within it, one that names several among all.
    """
    asked = questions.filter(F.trim("text") != "")
    named = find_medications(asked.select("question_id", "text"), catalogue).groupBy("question_id").agg(F.count("*").alias("n"), F.min("register").alias("register"))
    return asked.join(named, "question_id").select("question_id", "vector", F.when(F.col("n") == 1, F.col("register")).alias("only"))


def search(questions: DataFrame, catalogue: DataFrame, chunks: DataFrame, k: int = 5, threshold: float | None = None) -> DataFrame:
    """The top chunks (chunk_id, vector, register) of each question (question_id, text, vector)."""
    return retrieve(routed(questions, catalogue), chunks, k, threshold)


def run_evaluation(questions: DataFrame, catalogue: DataFrame, chunks: DataFrame, k: int = 5, mask: bool = True) -> tuple[DataFrame, DataFrame]:
    """(question_id, masked) of every question, and what ``search`` finds for the masked texts."""
    # Written: a filter by masked texts would else be planned before the joins that questions come from, and their texts masked several times.
    asked = durable(spread(questions, "question_id", 16).withColumn("seen", mask_pii(F.col("text"), mask)).withColumn("text", F.col("seen.masked")))
    return asked.select("question_id", F.col("seen.has_pii").alias("masked")), search(asked.drop("seen"), catalogue, chunks, k)
