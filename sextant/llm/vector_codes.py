"""Product codes of vectors: every part of a vector as the index of its nearest codebook entry.

All distances are exact integers. A part's nearest entry is found by partial distances: the
dimensions go in descending variance of the codebook's entries, and an entry is dropped as
soon as what has been added up strictly exceeds the best complete distance so far. A training
round is one scan: tasks add up their parts by entry, one aggregation adds up the tasks, and
only the codebooks, whose size is fixed, pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sextant.llm.common import discard, durable
from sextant.llm.vectors import usable

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Dimensions that all entries are held against before the first are dropped, and rows that a task searches at once.
LEAD, ROWS = 4, 1024
LIMIT = (1 << 63) - 1


class Codebook:
    """One part's entries, searched by partial distances."""

    def __init__(self, entries: np.ndarray):
        self.order = np.argsort(-entries.astype(np.float64).var(axis=0), kind="stable")
        self.by_dim = np.ascontiguousarray(entries[:, self.order].T)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each row's nearest entry, ties to the lower index."""
        found = [self._nearest(x[at : at + ROWS][:, self.order]) for at in range(0, len(x), ROWS)]
        return tuple(np.concatenate(f) for f in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, x.dtype))

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        book, rows = self.by_dim, np.arange(len(x))
        sums = np.zeros((len(x), book.shape[1]), x.dtype)
        for t in range(min(LEAD, len(book))):
            sums += np.square(x[:, t, None] - book[t])
        ahead = sums.argmin(axis=1)  # complete first, so that it bounds the others
        best = np.square(x - book[:, ahead].T).sum(axis=1, dtype=x.dtype)
        i, j = np.nonzero(sums <= best[:, None])
        sums, bound = sums[i, j], best[i]
        for t in range(LEAD, len(book)):
            sums += np.square(x[i, t] - book[t, j])
            alive = sums <= bound
            i, j, sums, bound = i[alive], j[alive], sums[alive], bound[alive]
        best = np.minimum.reduceat(sums, np.searchsorted(i, rows))
        i, j = (a[sums == best[i]] for a in (i, j))
        return j[np.searchsorted(i, rows)], best


def nearest_parts(books: list[Codebook], v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The rows' parts, their nearest entries and the distances, for each part position."""
    for k, book in enumerate(books):
        x = v[:, k * v.shape[1] // len(books) : (k + 1) * v.shape[1] // len(books)]
        yield x, *book.nearest(x)


def _seeds(rows: DataFrame, entries: int) -> np.ndarray:
    """The vectors of the smallest ids, ascending; of repeated ids the least one."""
    ids = rows.filter("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries)
    first = rows.join(F.broadcast(ids), "vec_id").groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").collect()
    return np.array([r.v for r in first])


def train(rows: DataFrame, seeds: np.ndarray, rounds: int, kind: type, parts: int = PARTS) -> list[np.ndarray]:
    """The codebooks of ``rows`` (v) after ``rounds`` from ``seeds``."""
    dim = seeds.shape[1] // parts
    books = [seeds[:, k * dim : (k + 1) * dim] for k in range(parts)]
    sc = rows.sparkSession.sparkContext
    sums = [f"s{d}" for d in range(dim)]
    schema = "part int, entry int, n long, " + ", ".join(f"{s} long" for s in sums)
    for _ in range(rounds):
        shared = sc.broadcast(books)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            coded = [Codebook(b.astype(kind)) for b in shared.value]
            total = np.zeros((parts, len(shared.value[0]), dim + 1), np.int64)
            for batch in batches:
                for k, (x, entry, _) in enumerate(nearest_parts(coded, _matrix(batch, kind))):
                    np.add.at(total[k, :, 1:], entry, x)
                    total[k, :, 0] += np.bincount(entry, minlength=total.shape[1])
            k, e = np.nonzero(total[:, :, 0])
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(e, pa.int32()), *(pa.array(c) for c in total[k, e].T)], names=["part", "entry", "n", *sums])

        added = rows.select("v").mapInArrow(work, schema).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *sums)]).collect()
        shared.destroy()
        books = [b.copy() for b in books]
        for r in added:
            books[r.part][r.entry] = np.array(r[3:]) // r.n
    return books


def _matrix(batch: pa.RecordBatch, kind: type) -> np.ndarray:
    v = batch.column("v")
    return v.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(v), -1)


def vector_codes(vectors: DataFrame, scale: int = 1024, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable row.

    ``vectors`` has vec_id, embedding and label; other columns are ignored. Components x
    become floor(scale * x). The codebooks begin with the parts of the ``entries`` smallest
    vec_ids (of a repeated id the least vector) and are trained for ``rounds``; entries that
    nothing uses stay. ``code`` has two hex digits for each part, ``error`` the squared
    distances' sum, ``label_error`` that of all rows of the label, null being a label.

    Vectors that are null, empty or hold null or non-finite components are left out, as are
    those whose length isn't that of the smallest vec_id's (of the lengths that can be cut
    into equal parts). Rows without a vec_id count and return but begin no entry; if no row
    has one, nothing is coded. Repeated rows count and return repeatedly. Distances that
    could exceed a long raise an error. An empty table gives an empty table.
    """
    spark, label = vectors.sparkSession, vectors.schema["label"]
    number = lambda x: x.cast("double") * scale
    sound = usable(F.transform("embedding", lambda x: x.cast("double"))) & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0)
    whole = vectors.filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform("embedding", lambda x: F.floor(number(x)).cast("long")).alias("v"), F.array_max(F.transform("embedding", lambda x: F.abs(number(x)))).alias("most"))
    whole = durable(whole)
    first = whole.agg(F.min(F.when(F.col("vec_id").isNotNull(), F.struct("vec_id", F.size("v").alias("dim")))).alias("first"), F.max("most").alias("most"), F.count("*").alias("n")).first()
    if first["first"] is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    dim, reach = first["first"]["dim"], first["most"] + 1
    if max(dim * (2 * reach) ** 2, reach) * first["n"] > LIMIT:
        raise ValueError("the vectors' distances, summed, could exceed a long")
    kind = np.int32 if dim * (2 * reach) ** 2 < 1 << 31 else np.int64
    rows = whole.filter(F.size("v") == dim).select("vec_id", "label", "v")
    books = train(rows, _seeds(rows, entries), rounds, kind, parts)
    shared = spark.sparkContext.broadcast(books)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = [Codebook(b.astype(kind)) for b in shared.value]
        for batch in batches:
            if not batch.num_rows:
                continue
            found = list(nearest_parts(coded, _matrix(batch, kind)))
            code = np.stack([entry for _, entry, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            error = reduce(np.add, (d.astype(np.int64) for _, _, d in found))
            codes = [code[at : at + 2 * parts] for at in range(0, len(code), 2 * parts)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label").cast(to_arrow_type(label.dataType)), pa.array(codes, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    schema = rows.select("vec_id", "label").withColumn("code", F.lit("")).withColumn("error", F.lit(0).cast("long")).schema
    out = durable(rows.mapInArrow(work, schema))
    discard(whole)
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    sums = out.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return out.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle(rounds: int = ROUNDS) -> str:
    """The codes of all ``embeddings`` as DuckDB SQL, by all distances."""
    steps = []
    for r in range(rounds + 1):
        each = f"SELECT p.row, p.part, p.x, min({{'d': list_sum(list_transform(list_zip(p.x, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'entry': b.entry}}) AS m FROM p JOIN b{r} b USING (part) GROUP BY p.row, p.part, p.x"
        steps.append(f"a{r} AS ({each})")
        if r < rounds:
            spread = f"SELECT part, m.entry AS entry, unnest(x) AS x, generate_subscripts(x, 1) AS place FROM a{r}"
            means = f"SELECT part, entry, list(mean ORDER BY place) AS e FROM (SELECT part, entry, place, CAST(floor(sum(x) / count(*)) AS BIGINT) AS mean FROM ({spread}) GROUP BY part, entry, place) GROUP BY part, entry"
            steps.append(f"b{r + 1} AS (SELECT part, entry, coalesce(n.e, b.e) AS e FROM b{r} b LEFT JOIN ({means}) n USING (part, entry))")
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT row, vec_id, k AS part, v[k * len(v) // 4 + 1 : (k + 1) * len(v) // 4] AS x FROM kept, range(4) parts(k)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS e FROM p QUALIFY entry < 256),
{", ".join(steps)},
digest AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
coded AS (SELECT row, string_agg(lpad(lower(to_hex(m.entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (row), digest"""
