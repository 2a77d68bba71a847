"""Hashed bags of words as vectors: a stand-in for an embedding model, without one; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components; a power of two, as the last bits of a word's MD5 give its component. Fixed value.
DIM = 64


def component(word: Column, dim: int = DIM) -> Column:
    """The component that a word counts in: its MD5, as a number, modulo ``dim``."""
    if dim & (dim - 1) or not 0 < dim <= 1 << 28:
        raise ValueError("dim must be a power of two, 2 ** 28 at most")
    return (F.conv(F.right(F.md5(word.cast("binary")), F.lit(7)), 16, 10).cast("long") % dim).cast("int")


def hashed_vectors(texts: DataFrame, key: str, dim: int = DIM) -> DataFrame:
    """(key, vector): unit vectors of word counts by component, of ``texts`` (key, text) with unique keys.

    Words are lower-case runs of letters, digits and underscores. Words are counted where
    the texts lie, so at most ``dim`` rows of a text are shuffled. Texts without words, null
    ones too, get a zero vector.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0))
    counted = texts.select(key, F.explode_outer(F.transform(words, lambda w: component(w, dim))).alias("at")).groupBy(key, "at").agg(F.count("at").alias("n"))
    some = F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "n")))
    size = F.sqrt(F.sum(F.col("n").cast("double") * F.col("n")))
    rows = counted.groupBy(key).agg(F.map_from_entries(some).alias("counts"), size.alias("size"))
    value = lambda d: F.coalesce(F.try_element_at("counts", d), F.lit(0)) / F.greatest("size", F.lit(1.0))
    return rows.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value).alias("vector"))
