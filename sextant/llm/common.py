"""What the corpus operators share: written intermediate tables and graph components."""

from __future__ import annotations

import ctypes

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.functions.scratch import discard, durable
from sextant.functions.text import trim_memory

__all__ = ["components", "discard", "durable", "join_roots", "keep_memory", "trim_memory"]
#: Names of mallopt's parameters. Fixed values.
M_TRIM_THRESHOLD, M_MMAP_THRESHOLD = -1, -3


def keep_memory() -> None:
    """Let a worker's C library keep freed blocks of up to 32 MB for the next arrays.

    Otherwise the pages of every array of a loop are mapped anew, a third of the loop's time.
    What is kept is bounded by the worker's own peak. Libraries without the call stay as they are.
    """
    library = ctypes.CDLL(None)
    if hasattr(library, "mallopt"):
        library.mallopt(M_MMAP_THRESHOLD, 1 << 25)
        library.mallopt(M_TRIM_THRESHOLD, 1 << 28)


def join_roots(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of i and j, pairwise; roots are the smallest members."""
    while len(i):
        a, b = parent[i], parent[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        low = np.minimum(a, b)
        np.minimum.at(parent, np.maximum(a, b), low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a long, b long) as (node, component).

    Large-star and small-star steps alternate until the edges are stars around the smallest
    node of each component; a step is one aggregation and one join on the node, so a node
    with very many links is split by the adaptive skew join. Nodes without links don't
    appear. Loops and repeated edges are ignored, null ends too.
    """
    edges = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        print_ = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if print_["n"] == 0 or print_ == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
        before = print_
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = durable(large.filter("a <> b").distinct())
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        stars = durable(small.filter("a <> b").distinct())
        discard(edges)
        discard(large)
        edges = stars
