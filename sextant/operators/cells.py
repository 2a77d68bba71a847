"""A metric index of vectors: cells around centroids, which stay closed where no vector of theirs can rank.

A vector c of a cell with centroid m and radius r has q.c = q.m + q.(c - m) <= q.m + |q| r
for every question q. The cells of the highest bounds are opened first; the k-th score that
they give closes all cells below it, and the others are opened, so the result is exact.
Cells are put together into blocks. A question is sent once to each block in which it opens a
cell, and a block once to each group of its questions, both of bounded size; what a task
shuffles on is the best ``k`` of a question only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sextant.functions.scratch import durable

#: Vectors that centroids are fitted on, by hash; rounds of it; the most cells.
SAMPLE, ROUNDS, CELLS = 8192, 4, 1024
#: Components of a block of chunks, and of a group of questions that meet it in a task: 32,768 and 16,384 vectors of length 64. Shorter vectors than ``LEAST`` count as so long.
CHUNKS, QUESTIONS, LEAST = 1 << 21, 1 << 20, 32
#: Vectors on either side that are multiplied at once.
STRIP = 1024
#: Cells that a question opens before any floor is known.
FIRST = 2
#: Below this, two ways of adding up the same products differ, for vectors of length 1.
ROUNDING = 1e-9


def matrices(table: pa.Table | pa.RecordBatch, vector: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows of each vector length with their vectors."""
    table = table if isinstance(table, pa.Table) else pa.Table.from_batches([table])
    sizes = np.asarray(pc.list_value_length(table.column(vector).combine_chunks()))
    for dim in np.unique(sizes):
        own = table.filter(pa.array(sizes == dim))
        flat = own.column(vector).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        yield own, flat.astype(np.float64).reshape(len(own), int(dim))


def _length(v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(v).sum(1))


def _nearest(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (v @ centroids.T - 0.5 * np.square(centroids).sum(1)).argmax(1)


def centroids(chunks: DataFrame, cells: int | None = None) -> dict[int, np.ndarray]:
    """Centroids by vector length, fitted on a sample of ``chunks`` (chunk_id, c); about the root of the number of chunks."""
    sample = chunks.orderBy(F.xxhash64("chunk_id")).limit(SAMPLE).select("c").toArrow()
    whole = chunks.count()
    out = {}
    for own, v in matrices(sample, "c") if sample.num_rows else ():
        many = cells or int(np.clip(np.sqrt(whole * len(own) / sample.num_rows), 1, CELLS))
        found = v[: min(many, len(v))].copy()
        for _ in range(ROUNDS):
            at = _nearest(v, found)
            sums = np.zeros_like(found)
            np.add.at(sums, at, v)
            n = np.bincount(at, minlength=len(found))
            found[n > 0] = sums[n > 0] / n[n > 0, None]
        out[v.shape[1]] = found
    return out


class Cells:
    """The index of ``chunks`` (chunk_id, register, c); rows and cells are written."""

    def __init__(self, chunks: DataFrame, cells: int | None = None):
        chunks = chunks.select("chunk_id", "register", "c")
        self.of = {dim: m for dim, m in centroids(chunks, cells).items()}
        shared = chunks.sparkSession.sparkContext.broadcast(self.of)
        schema = T.StructType([*chunks.schema.fields, T.StructField("dim", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, v in matrices(batch, "c"):
                    m = shared.value.get(v.shape[1], np.zeros((1, v.shape[1])))  # a length that the sample lacks is one cell
                    at = _nearest(v, m)
                    away = _length(v - m[at])
                    new = [pa.array(np.full(len(v), v.shape[1], np.int32)), pa.array(at.astype(np.int32)), pa.array(away)]
                    yield from pa.Table.from_arrays([*(rows.column(c).combine_chunks() for c in ("chunk_id", "register", "c")), *new], names=schema.names).to_batches()

        placed = durable(chunks.mapInArrow(work, schema))
        shared.destroy()
        #: dim, cell, radius, n: as many rows as there are centroids, and one for each further length.
        self.cells = placed.groupBy("dim", "cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect()
        self.rows = placed
        self._put_into_blocks()

    def _put_into_blocks(self) -> None:
        """``blocks``: by vector length the cells' centroids, radii and numbers, and which blocks hold their chunks; ``where``: the latter as (dim, cell, start, spread)."""
        where, self.blocks, last = [], {}, -1
        for dim in sorted({r.dim for r in self.cells}):
            own, room = sorted((r for r in self.cells if r.dim == dim), key=lambda r: r.cell), 0
            for r in own:
                size = r.n * max(dim, LEAST)
                if size > room:
                    last, room = last + 1, CHUNKS
                spread = ceil(size / CHUNKS)
                where.append((dim, r.cell, last, spread))
                last, room = last + spread - 1, room - size if spread == 1 else 0
            starts = [w[2:] for w in where[-len(own) :]]
            first = starts[0][0]
            holds = np.zeros((len(own), last + 1 - first), np.float32)
            for i, (start, spread) in enumerate(starts):
                holds[i, start - first : start - first + spread] = 1
            middle = np.array([self.of[dim][r.cell] if dim in self.of else np.zeros(dim) for r in own]).reshape(len(own), dim)
            self.blocks[dim] = middle, np.array([r.radius for r in own]), np.array([r.cell for r in own], np.int32), holds, first
        self.where = self.rows.sparkSession.createDataFrame(where, "dim int, cell int, start int, spread int")

    def dealt(self, questions: DataFrame, first: int = 0, to: str = "block") -> DataFrame:
        """A row of ``questions`` (question_id, q, floor), with its vector's length as dim, for each block, or cell, that it opens: the ``first`` cells, or those that can reach its floor."""
        shared = questions.sparkSession.sparkContext.broadcast(self.blocks)
        schema = T.StructType([*questions.schema.fields, T.StructField("dim", T.IntegerType()), T.StructField(to, T.IntegerType())])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, q in matrices(batch, "q"):
                    if q.shape[1] not in shared.value:
                        continue
                    middle, radius, cell, holds, start = shared.value[q.shape[1]]
                    for at in range(0, len(q), STRIP):
                        some = rows.slice(at, STRIP)
                        opens = opened(q[at : at + STRIP], middle, radius, _floors(some), first)
                        who, what = np.nonzero(opens if to == "cell" else opens.astype(np.float32) @ holds)
                        new = [pa.array(np.full(len(who), q.shape[1], np.int32)), pa.array(cell[what] if to == "cell" else (start + what).astype(np.int32))]
                        took = some.take(pa.array(who))
                        yield from pa.Table.from_arrays([*(took.column(c).combine_chunks() for c in rows.column_names), *new], names=schema.names).to_batches()

        return questions.mapInArrow(work, schema)

    def opened(self, questions: DataFrame, k: int, first: int = 0) -> DataFrame:
        """question_id, chunk_id, register, score with the ``k`` best of each block for its questions (question_id, q, floor), as far as they reach the floor."""
        groups = durable(self.dealt(questions, first).groupBy("dim", "block").agg(F.ceil(F.count("*") * F.greatest("dim", F.lit(LEAST)) / QUESTIONS).cast("int").alias("groups")))
        asked = self.dealt(questions, first).join(F.broadcast(groups), ["dim", "block"])
        asked = asked.select("dim", "block", F.pmod(F.xxhash64("question_id"), F.col("groups")).cast("int").alias("part"), "question_id", "q", "floor")
        rows = self.rows.join(F.broadcast(self.where), ["dim", "cell"]).withColumn("block", (F.col("start") + F.pmod(F.xxhash64("chunk_id"), F.col("spread"))).cast("int")).join(F.broadcast(groups), ["dim", "block"])
        rows = rows.select("dim", "block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), "chunk_id", "register", "c", "cell")
        shared = questions.sparkSession.sparkContext.broadcast(self.blocks)

        def pairs(asked: pa.Table, q: np.ndarray, found: pa.Table, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            middle, radius, cell, *_ = shared.value[q.shape[1]]
            floor, at = _floors(asked), found.column("cell").to_numpy()
            opens = np.concatenate([opened(q[i : i + STRIP], middle, radius, floor[i : i + STRIP], first) for i in range(0, len(q), STRIP)])
            for x, j in _by_value(at):
                yield np.flatnonzero(opens[:, np.searchsorted(cell, x)]), j

        return meet(asked, rows, ("dim", "block", "part"), k, pairs)

    def nearest(self, questions: DataFrame, k: int, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
        """question_id, chunk_id, register, score with the ``k`` best of each question (question_id, q) among them; and the pairs of questions and cells that were opened."""
        asked = questions.select("question_id", "q")
        seen = self.opened(asked.withColumn("floor", F.lit(None).cast("double")), k, first)
        place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score")))
        floors = durable(seen.withColumn("at", place).filter(F.col("at") == k).select("question_id", F.col("score").alias("floor")))
        asked = asked.join(floors, "question_id", "left")
        return self.opened(asked, k), self.dealt(asked, to="cell").drop("q", "floor")


def opened(q: np.ndarray, middle: np.ndarray, radius: np.ndarray, floor: np.ndarray, first: int) -> np.ndarray:
    """Which cells each question opens: the ``first`` by their bounds or, with 0, those that can reach its floor."""
    size = _length(q)[:, None]
    bound = q @ middle.T + size * radius + ROUNDING * (1 + size * (radius + _length(middle)))
    if 0 < first < len(middle):
        out = np.zeros(bound.shape, bool)
        np.put_along_axis(out, np.argpartition(-bound, first - 1, axis=1)[:, :first], True, 1)
        return out
    # Scores are held within 0 and 1, so a floor of 0 opens every cell: ties go by chunk_id.
    return ~((bound < floor[:, None]) & (floor[:, None] > 0))


def _floors(rows: pa.Table) -> np.ndarray:
    return rows.column("floor").fill_null(-1.0).to_numpy()


def _by_value(values: np.ndarray) -> Iterator[tuple[object, np.ndarray]]:
    """Each value with the places that have it, in their order."""
    order = np.argsort(values, kind="stable")
    each, at = np.unique(values[order], return_index=True)
    yield from zip(each, np.split(order, at[1:]), strict=True)


def within(questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """question_id, chunk_id, register, score with the ``k`` best chunks (chunk_id, register, c) of the register ``only`` of each question (question_id, q, only), and more.

    Registers are dealt to blocks by hash; a large one to several of its own, each of which
    meets its questions in groups.
    """
    q = questions.select("question_id", "q", F.col("only").cast(chunks.schema["register"].dataType).alias("register"), F.size("q").alias("dim")).filter("register is not null")
    c = chunks.select("chunk_id", "register", "c", F.size("c").alias("dim")).filter("register is not null")
    weight = F.count("*") * F.greatest("dim", F.lit(LEAST))
    sizes = q.groupBy("register", "dim").agg(weight.alias("asked")).join(c.groupBy("register", "dim").agg(weight.alias("held")), ["register", "dim"])
    sizes = durable(sizes.withColumn("groups", F.ceil(F.col("asked") / QUESTIONS).cast("int")).withColumn("blocks", F.ceil(F.col("held") / CHUNKS).cast("int")))
    whole = sizes.agg(F.sum("asked"), F.sum("held")).first()
    shelves = 2 * max(ceil((whole[0] or 0) / QUESTIONS), ceil((whole[1] or 0) / CHUNKS), 1)
    small = (F.col("groups") == 1) & (F.col("blocks") == 1)
    sizes = sizes.select("register", "dim", "groups", "blocks", F.when(small, F.pmod(F.xxhash64("register"), F.lit(shelves))).otherwise(-1 - F.abs(F.xxhash64("register") % (1 << 62))).alias("shelf"))
    asked = q.join(sizes, ["register", "dim"]).select("dim", F.col("shelf").alias("shelf"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("question_id"), F.col("groups")).cast("int").alias("part"), "question_id", "q", "register")
    rows = c.join(sizes, ["register", "dim"]).select("dim", F.col("shelf").alias("shelf"), F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), "chunk_id", "register", "c")

    def pairs(asked: pa.Table, q: np.ndarray, found: pa.Table, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        every = pa.chunked_array([*found.column("register").chunks, *asked.column("register").chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
        who = dict(_by_value(every[len(c) :]))
        for x, j in _by_value(every[: len(c)]):
            if x in who:
                yield who[x], j

    return meet(asked, rows, ("dim", "shelf", "block", "part"), k, pairs)


def meet(asked: DataFrame, rows: DataFrame, keys: tuple[str, ...], k: int, pairs: Callable) -> DataFrame:
    """question_id, chunk_id, register, score with the ``k`` best of ``rows`` for each row of ``asked`` with the same ``keys``, of the places of rows that ``pairs`` gives together."""
    schema = T.StructType([asked.schema["question_id"], rows.schema["chunk_id"], rows.schema["register"], T.StructField("score", T.DoubleType())])

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([], schema=to_arrow_schema(schema))
        right = right.take(pc.sort_indices(right, [("chunk_id", "ascending")], null_placement="at_start"))
        (left, q), (right, c) = next(matrices(left, "q")), next(matrices(right, "c"))
        best = Best(q, c, k, _floors(left) if "floor" in left.column_names else np.full(len(q), -1.0))
        for i, j in pairs(left, q, right, c):
            best.meet(i, j)
        who, place = np.nonzero(best.row < len(c))
        at, to = pa.array(who), pa.array(best.row[who, place])
        return pa.table([left.column("question_id").take(at), right.column("chunk_id").take(to), right.column("register").take(to), pa.array(best.score[who, place])], names=schema.names)

    return asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(work, schema)


class Best:
    """The ``k`` best rows of ``c`` for each row of ``q`` so far, from its floor on: by scores, within 0 and 1, then by their order.

    Products in single precision tell which pairs can rank, up to ``slack``; those are scored exactly.
    """

    def __init__(self, q: np.ndarray, c: np.ndarray, k: int, floor: np.ndarray):
        self.k, self.floor, self.vectors = k, floor, np.ascontiguousarray(c)
        self.qt, self.ct = np.ascontiguousarray(q.T), np.ascontiguousarray(c.T)
        with np.errstate(over="ignore"):
            self.q, self.c = q.astype(np.float32), c.astype(np.float32)
        self.slack = (q.shape[1] + 8) * 2.0**-22 * (1 + _length(q) * _length(c).max(initial=0.0))
        self.score, self.row = np.full((len(q), k), -1.0), np.full((len(q), k), len(c))

    def meet(self, i: np.ndarray, j: np.ndarray) -> None:
        """The questions at ``i`` see the rows at ``j``, which are none that they saw before."""
        j = self.ranking(j) if len(i) else j
        for a in range(0, len(i), STRIP):
            for b in range(0, len(j), STRIP):
                self._strip(i[a : a + STRIP], j[b : b + STRIP])

    def ranking(self, j: np.ndarray) -> np.ndarray:
        """``j`` without the rows before which ``k`` equal ones stand, as those can't rank."""
        rows = self.vectors[j]
        same = np.unique(rows.view(f"V{rows.shape[1] * rows.itemsize}").ravel(), return_inverse=True)[1] if rows.shape[1] else np.zeros(len(j), np.int64)
        order = np.argsort(same, kind="stable")
        same = same[order]
        return j[np.sort(order[np.arange(len(j)) - np.searchsorted(same, same) < self.k])]

    def _strip(self, i: np.ndarray, j: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            rough = self.q[i] @ self.c[j].T
        least, slack = np.maximum(self.floor[i], self.score[i, -1]), self.slack[i]
        bar = np.where(least > 0, least, -np.inf)
        new = np.flatnonzero(least < 0)
        if len(new) and len(j) > self.k:
            kth = np.partition(rough[new], -self.k, axis=1)[:, -self.k].astype(np.float64)
            bar[new] = np.where(kth > slack[new], np.minimum(kth, 1.0) - slack[new], -np.inf)
        # Not below the bar, so that products that are no numbers go on: SQL holds them for the largest.
        x, y = np.divmod(np.flatnonzero(~(rough < (bar - slack).astype(np.float32)[:, None])), len(j))
        # Products are added up one after the other, as SQL does, so that scores and ties are the same.
        who, what, score = i[x], j[y], np.zeros(len(x))
        for a, b in zip(self.qt, self.ct, strict=True):
            score += a[who] * b[what]
        score = np.where(np.isnan(score), 1.0, np.clip(score, 0.0, 1.0)) + 0.0
        keep = score >= least[x]
        if keep.any():
            self._merge(who[keep], what[keep], score[keep])

    def _merge(self, who: np.ndarray, what: np.ndarray, score: np.ndarray) -> None:
        own = np.unique(who)
        who, what, score = np.concatenate([who, np.repeat(own, self.k)]), np.concatenate([what, self.row[own].ravel()]), np.concatenate([score, self.score[own].ravel()])
        order = np.lexsort((what, -score, who))
        who = who[order]
        order = order[np.arange(len(who)) - np.searchsorted(who, who) < self.k]
        self.row[own], self.score[own] = what[order].reshape(-1, self.k), score[order].reshape(-1, self.k)
