"""Ranking chunks for questions: cosine and rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.scratch import durable
from sextant.operators.cells import Cells, within

FUSION = 60


def sound(vector: Column) -> Column:
    """The vector is there and has no null component."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull())


def top(scored: DataFrame, k: int, by: tuple[str, ...] = ("question_id",), tie: str = "chunk_id") -> DataFrame:
    """The ``k`` best rows of each question with their rank; ties by ``tie``. Planned with a group limit before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), tie)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def retrieve(questions: DataFrame, chunks: DataFrame, k: int = 5, threshold: float | None = None) -> DataFrame:
    """Top chunks by cosine for each question (question_id, vector, only) from chunks (chunk_id, vector, register).

    ``only`` is the single entity that the question resolves to, or null for a search over
    all chunks. The former meet the chunks of their entity. The latter open those cells of a
    metric index (see ``cells``) that can still hold one of their best ``k``. Both meet in
    blocks of bounded size, which return the best only. The cosine of unit vectors is held
    within 0 and 1; a product that is no number counts as 1, as in SQL. Vectors that are null, hold
    nulls or differ in length don't meet.
    Blank questions and questions without any entity are left out before. The threshold
    applies after the top k.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if threshold is not None and not 0 <= threshold <= 1:
        raise ValueError("threshold must be within 0 and 1")
    q = questions.select("question_id", F.col("vector").alias("q"), "only").filter(sound(F.col("q")))
    c = chunks.select("chunk_id", F.col("vector").alias("c"), "register").filter(sound(F.col("c")))
    q = durable(q)
    named, open_ = q.filter("only is not null"), q.filter("only is null")
    if open_.isEmpty():
        every = within(named, c, k)
    else:
        every = Cells(c).nearest(open_, k)[0]
        every = every if named.isEmpty() else every.unionByName(within(named, c, k))
    found = top(every, k)
    return found if threshold is None else found.filter(F.col("score") >= threshold)


def fuse(rankings: list[DataFrame], k: int = 5, constant: int = FUSION) -> DataFrame:
    """Reciprocal rank fusion of rankings (question_id, chunk_id, rank)."""
    every = rankings[0].select("question_id", "chunk_id", "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select("question_id", "chunk_id", "rank"))
    scored = every.groupBy("question_id", "chunk_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 10).alias("score"))
    return top(scored, k)
