"""Exact top-k by integer inner product with multi-resolution segment statistics.

A vector is cut into equal segments of which mean and deviation norm are kept, at several
resolutions. With q.v = sum over segments of n * mean * mean + deviations' product, and the
deviations' product at most the product of their norms, every resolution bounds the squared
distance |q|^2 + |v|^2 - 2 q.v from below, that is the inner product from above. Going from
coarse to fine, a pair is dropped once its bound is below the query's current k-th score;
exact products are computed for the survivors alone.

Queries are taken in waves of bounded size. A wave is broadcast and one scan holds every row
where it lies against all of its blocks: the rows are never shuffled, and a wave's results are
written before the next one. The queries' exact scores against a bounded sample of rows,
computed where the queries lie, give each a first k-th score, so that a task returns few rows
besides the final ones. Scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import durable
from sextant.llm.vectors import matrix, usable

#: Queries of a block; components of a wave's queries and of the sample for the first thresholds; rows of that sample at most.
QUERY_BLOCK = 4096
WAVE_CELLS, SEED_CELLS = 1 << 22, 1 << 20
SEED_ROWS = 8192
#: Sums below this are exact in double precision, and below the other in 64-bit integers.
EXACT_DOUBLE, EXACT_LONG = 2.0**53, 2.0**63
NONE = np.iinfo(np.int64).min
SEGMENTS = (4, 16)
#: Rows scored at once in a task, and the share of surviving pairs above which a whole block is multiplied.
ROWS = 1024
DENSE = 0.05


def statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """Per row: sqrt(n) * mean of each segment, then each segment's deviation norm."""
    dim = v.shape[1]
    parts = np.array_split(np.arange(dim), min(segments, dim))
    means = np.stack([v[:, p].mean(1) for p in parts], 1)
    deviations = np.stack([np.sqrt(np.maximum(0.0, ((v[:, p] - m[:, None]) ** 2).sum(1))) for p, m in zip(parts, means.T, strict=True)], 1)
    return np.concatenate((means * np.sqrt([len(p) for p in parts]), deviations), 1)


class Block:
    """Queries of one length with their statistics, and the k best rows of each so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.q, self.k = ids, q, k
        self.stats = [statistics(q, s) for s in SEGMENTS]
        self.slack = 1e-9 * (1 + np.abs(q).sum(1).max(initial=0) * (1 + np.abs(q).max(initial=0)))
        self.most = np.abs(q).max(initial=0) * q.shape[1]
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.astype(float)
        self.best_score = np.full((len(ids), k), NONE)
        self.best_id = np.full((len(ids), k), np.iinfo(np.int64).max)

    def survivors(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Pairs (query, row) that the bounds leave; None if too many for a list."""
        least = self.floor - self.slack * (1 + np.abs(v).max(initial=0))
        left = self.stats[0] @ statistics(v, SEGMENTS[0]).T >= least[:, None]
        if left.mean() > DENSE:
            fine = self.stats[-1] @ statistics(v, SEGMENTS[-1]).T >= least[:, None]
            left &= fine
            if left.mean() > DENSE:
                return None
            return np.nonzero(left)
        i, j = np.nonzero(left)
        for stats, s in zip(self.stats[1:], SEGMENTS[1:], strict=True):
            rows = statistics(v, s)
            keep = np.einsum("ij,ij->i", stats[i], rows[j]) >= least[i]
            i, j = i[keep], j[keep]
        return i, j

    def scored(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (query, row) that may be among the best, and their exact scores."""
        largest = np.abs(v).max(initial=0)
        most = self.most * largest
        if most >= EXACT_LONG or max(largest, self.most / self.q.shape[1]) >= EXACT_DOUBLE:
            raise ValueError("components are too large: a score could exceed a long")
        if most >= EXACT_DOUBLE:
            score = self.q.astype(np.int64) @ v.astype(np.int64).T
            i, j = np.nonzero(score >= self.floor[:, None] - 2 * np.spacing(most))
            return i, j, score[i, j]
        pairs = self.survivors(v)
        if pairs is None:
            score = self.q @ v.T
            i, j = np.nonzero(score >= self.floor[:, None])
            score = score[i, j]
        else:
            i, j = pairs
            score = np.einsum("ij,ij->i", self.q[i], v[j])
            keep = score >= self.floor[i]
            i, j, score = i[keep], j[keep], score[keep]
        return i, j, score.astype(np.int64)

    def add(self, ids: np.ndarray, v: np.ndarray) -> None:
        i, j, score = self.scored(v)
        keep = self.ids[i] != ids[j]
        i, j, score = i[keep], j[keep], score[keep]
        if not len(i):
            return
        touched, at = np.unique(i, return_inverse=True)
        rows = np.concatenate((np.repeat(np.arange(len(touched)), self.k), at))
        scores = np.concatenate((self.best_score[touched].ravel(), score))
        cand = np.concatenate((self.best_id[touched].ravel(), ids[j]))
        order = np.lexsort((~scores, cand, rows))
        rows, scores, cand = rows[order], scores[order], cand[order]
        fresh = np.concatenate(([True], (rows[1:] != rows[:-1]) | (cand[1:] != cand[:-1])))
        rows, scores, cand = rows[fresh], scores[fresh], cand[fresh]
        order = np.lexsort((cand, ~scores, rows))
        rows, scores, cand = rows[order], scores[order], cand[order]
        first = np.searchsorted(rows, np.arange(len(touched)))
        rank = np.arange(len(rows)) - first[rows]
        top = rank < self.k
        self.best_score[touched[rows[top]], rank[top]] = scores[top]
        self.best_id[touched[rows[top]], rank[top]] = cand[top]
        self.floor = np.maximum(self.floor, np.where(self.best_score[:, -1] == NONE, -np.inf, self.best_score[:, -1].astype(float)))


def _by_length(table: pa.Table | pa.RecordBatch, *more: str) -> Iterator[tuple]:
    """Ids, vectors and the columns ``more`` of the rows of each length."""
    lists = table.column("v")
    sizes = np.asarray(pc.list_value_length(lists))
    for dim in np.unique(sizes):
        own = table.filter(pa.array(sizes == dim))
        v = own.column("v")
        yield own.column("vec_id").to_numpy(), matrix(v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v, int(dim)), *(own.column(c).to_numpy() for c in more)


def _feed(blocks: list[Block], ids: np.ndarray, v: np.ndarray) -> None:
    for block in blocks:
        if block.q.shape[1] == v.shape[1]:
            for at in range(0, len(ids), ROWS):
                block.add(ids[at : at + ROWS], v[at : at + ROWS])


def vector_topk(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` highest integer inner products of each query against all other rows.

    ``vectors`` has vec_id and embedding; other columns are ignored. Components x become
    floor(scale * x). Queries are the rows whose vec_id is divisible by ``every``. Returns
    query_id, rank from 1, vec_id, score; ties go to the smaller vec_id; fewer than ``k``
    rows if there are no more. A row is named by its vec_id: repeated rows answer once and
    appear once, with their best score, and a query isn't its own candidate. Rows with a
    null vec_id, and vectors that are null, empty or hold null or non-finite components,
    take no part; vectors of different lengths don't meet. Scores that could exceed a long
    raise an error. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    sound = usable(F.transform("embedding", lambda x: x.cast("double"))) & (F.size("embedding") > 0) & F.col("vec_id").isNotNull()
    rows = durable(vectors.filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")))
    queries = durable(rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")))
    size = queries.agg(F.count("*").alias("n"), F.sum(F.size("v")).alias("cells")).first()
    if not size.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    seeds = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(SEED_ROWS, SEED_CELLS * size.n // size.cells)))
    seeded = durable(_seeded(queries, seeds.toArrow(), k))
    waves = -(-size.cells // WAVE_CELLS)
    found = []
    for wave in range(waves):
        own = seeded if waves == 1 else seeded.filter(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == wave)
        found.append(_search(rows, own.toArrow(), k, query_block))
    every_wave = reduce(DataFrame.union, found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every_wave.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _seeded(queries: DataFrame, sample: pa.Table, k: int) -> DataFrame:
    """``queries`` with their k-th best score in the sample, -inf if there are fewer."""
    shared = queries.sparkSession.sparkContext.broadcast(list(_by_length(sample)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, q in _by_length(batch):
                for at in range(0, len(ids), ROWS):
                    block = Block(ids[at : at + ROWS], q[at : at + ROWS], k)
                    for names, v in shared.value:
                        _feed([block], names, v)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(block.ids) + 1, dtype=np.int32) * q.shape[1]), pa.array(block.q.ravel().astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(block.ids), lists, pa.array(block.floor)], names=["vec_id", "v", "least"])

    return queries.mapInArrow(work, "vec_id long, v array<long>, least double")


def _search(rows: DataFrame, own: pa.Table, k: int, query_block: int) -> DataFrame:
    """(query_id, vec_id, score) that each task leaves of one wave, written."""
    parts = [(ids[at : at + query_block], q[at : at + query_block], least[at : at + query_block]) for ids, q, least in _by_length(own, "least") for at in range(0, len(ids), query_block)]
    shared = rows.sparkSession.sparkContext.broadcast(parts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [Block(ids, q, k, least) for ids, q, least in shared.value]
        for batch in batches:
            for ids, v in _by_length(batch):
                _feed(blocks, ids, v)
        for block in blocks:
            i, r = np.nonzero(block.best_score != NONE)
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[i]), pa.array(block.best_id[i, r]), pa.array(block.best_score[i, r])], names=["query_id", "vec_id", "score"])

    found = durable(rows.mapInArrow(work, "query_id long, vec_id long, score long"))
    shared.destroy()
    return found
