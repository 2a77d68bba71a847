"""Near-duplicate vectors by an epsilon grid order join.

Cosine >= c of unit vectors is a Euclidean distance of at most epsilon = sqrt(2 - 2c). Equal
vectors are collapsed. The others get the coordinates of their grid cell, of side epsilon,
on the leading principal dimensions, and are range-partitioned by them: the epsilon grid
order. The order is cut into sequence intervals. Their join is a recursion over the order:
runs of ``FANOUT`` ** level intervals have bounding boxes, and from the whole sequence down
only pairs of runs whose boxes are within epsilon are opened into the pairs of their parts.
Within a pair of intervals the join goes on halving both, skips halves whose boxes are
provably distant and multiplies the rest in double precision. A pair of intervals is one
task, which returns each vector's links as a count and a forest of the links only, so large
groups cost no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import components, durable, join_roots
from sextant.llm.vectors import usable

#: Principal dimensions of the grid.
GRID_DIMS = 6
#: Vectors, by hash, of which the principal dimensions of a length are fitted.
FIT_ROWS = 4096
#: Lengths, the commonest, that get principal dimensions; the grid of others is on their first coordinates.
FIT_LENGTHS = 64
#: Vectors of a sequence interval: at least, and so many that its components are about as many as the other.
LEAST_INTERVAL, INTERVAL_CELLS = 256, 1 << 20
#: Vectors of the halves below which the join multiplies.
LEAF = 256
#: Runs of intervals that make one of the next level.
FANOUT = 8
#: Slack of the distance bounds against rounding.
SLACK = 1e-6
LOW, HIGH = [f"low{i}" for i in range(GRID_DIMS)], [f"high{i}" for i in range(GRID_DIMS)]


def principal(unit: np.ndarray, dims: int) -> np.ndarray:
    """Leading principal directions as columns."""
    centred = unit - unit.mean(0)
    return np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :dims]


def units(flat: bytes, kind: str, dim: int) -> np.ndarray:
    v = np.frombuffer(flat, kind).astype(np.float64).reshape(-1, dim)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def distant(low_a, high_a, low_b, high_b, eps: float) -> bool:
    gap = np.maximum(0.0, np.maximum(low_a - high_b, low_b - high_a))
    return float(gap @ gap) > (eps + SLACK) ** 2


def interval_join(ua: np.ndarray, pa_: np.ndarray, ub: np.ndarray, pb: np.ndarray, same: bool, cosine: float, eps: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """Blocks (a start, b start, mask of linked pairs) of two sequence intervals, one with itself if ``same``."""
    todo = [(0, len(ua), 0, len(ub))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if distant(pa_[a0:a1].min(0), pa_[a0:a1].max(0), pb[b0:b1].min(0), pb[b0:b1].max(0), eps):
            continue
        if max(a1 - a0, b1 - b0) > LEAF:
            am, bm = (a0 + a1) // 2 if a1 - a0 > LEAF else a1, (b0 + b1) // 2 if b1 - b0 > LEAF else b1
            todo += [(x, y, z, w) for x, y in ((a0, am), (am, a1)) for z, w in ((b0, bm), (bm, b1)) if x < y and z < w and not (same and w <= x)]
            continue
        near = ua[a0:a1] @ ub[b0:b1].T >= cosine
        if same:
            near &= np.arange(a0, a1)[:, None] < np.arange(b0, b1)[None, :]
        if near.any():
            yield a0, b0, near


def fitted_axes(groups: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Principal dimensions of the commonest vector lengths, from ``FIT_ROWS`` of each by hash."""
    lengths = [r.dim for r in groups.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(FIT_LENGTHS).collect()]
    place = F.row_number().over(Window.partitionBy("dim").orderBy("h1", "h2"))
    sample = groups.filter(F.col("dim").isin(lengths)).withColumn("place", place).filter(F.col("place") <= FIT_ROWS)

    def fit(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
        axes = principal(units(v.tobytes(), kind, dim), min(GRID_DIMS, dim))
        return pa.table({"dim": [dim], "axes": [axes.tobytes()]})

    rows = sample.select("dim", "v").groupBy("dim").applyInArrow(fit, "dim long, axes binary").collect()
    return {r.dim: np.frombuffer(r.axes, np.float64).reshape(r.dim, -1) for r in rows}


def embedding_dedup(vectors: DataFrame, cosine: float = 0.95, interval: int | None = None) -> DataFrame:
    """Links and components of ``vectors`` (vec_id, embedding; other columns are ignored).

    One row per input row: vec_id, n_links (other vectors with cosine >= ``cosine``, equal
    ones included), component_id (smallest vec_id that links reach), kept (vec_id is the
    component_id). Vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing and are kept; vectors of different lengths don't link.
    Repeated rows are vectors of their own that link with each other, and return
    repeatedly. Rows without a vec_id count as vectors and carry links on, but name no
    component: where nothing else is reached, theirs is null. An empty table gives an empty
    table. ``interval`` is the length of a sequence interval, by default one that gives every
    core a task and bounds a task's memory. Equal vectors are known by a 128-bit hash.
    """
    eps = float(np.sqrt(2 - 2 * cosine))
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    v = F.col("embedding") if kind == "<f4" else F.transform("embedding", lambda x: x.cast("double"))
    sound = usable(v) & (F.size(v) > 0) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, v).alias("v"))
    rows = durable(rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v")))
    groups = rows.filter("v is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    groups = durable(groups.withColumn("dim", F.size("v")).withColumn("node", F.monotonically_increasing_id()))
    links, forest = _join(groups, kind, cosine, eps, interval)
    found = components(forest).select(F.col("node").alias("n"), "component")
    named = durable(groups.select("node", "h1", "h2", "rep", "copies").join(found, F.col("node") == F.col("n"), "left").withColumn("component", F.coalesce("component", "node")).drop("n"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").join(links, "node", "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", F.when(F.col("v").isNotNull(), F.col("h1")).alias("h1"), "h2").join(named, ["h1", "h2"], "left")
    alone = F.when(F.col("n_links").isNull(), F.col("vec_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", alone).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _boxes(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.min(c).alias(c) for c in LOW], *[F.max(c).alias(c) for c in HIGH])


def interval_pairs(intervals: DataFrame, eps: float) -> DataFrame:
    """(dim, a, b) of the ``intervals`` (dim, at, boxes) within epsilon, a <= b, by opening pairs of runs from the whole sequence down."""
    last = intervals.agg(F.max("at")).first()[0]
    levels = [intervals]
    while last:
        last //= FANOUT
        levels.append(durable(_boxes(levels[-1], "dim", F.floor(F.col("at") / FANOUT).alias("at"))))
    pairs = levels[-1].select("dim", F.col("at").alias("a"), F.col("at").alias("b"))
    for level in reversed(levels[:-1]):
        side = lambda x: level.select(F.col("dim").alias(f"{x}_dim"), F.floor(F.col("at") / FANOUT).alias(f"{x}_up"), F.col("at").alias(f"{x}_at"), *[F.col(c).alias(f"{x}_{c}") for c in LOW + HIGH])  # noqa: B023, E731
        gap = lambda lo, hi: F.greatest(F.lit(0.0), F.col(f"a_{lo}") - F.col(f"b_{hi}"), F.col(f"b_{lo}") - F.col(f"a_{hi}"))
        near = sum(gap(lo, hi) * gap(lo, hi) for lo, hi in zip(LOW, HIGH, strict=True)) <= (eps + SLACK) ** 2
        opened = pairs.join(side("a"), (F.col("dim") == F.col("a_dim")) & (F.col("a") == F.col("a_up"))).join(side("b"), (F.col("dim") == F.col("b_dim")) & (F.col("b") == F.col("b_up")))
        pairs = opened.filter((F.col("a_at") <= F.col("b_at")) & near).select("dim", F.col("a_at").alias("a"), F.col("b_at").alias("b"))
    return pairs


def _join(groups: DataFrame, kind: str, cosine: float, eps: float, interval: int | None) -> tuple[DataFrame, DataFrame]:
    """(node, links) and the forest edges (a, b) of distinct vectors (node, copies, v, dim)."""
    axes = fitted_axes(groups, kind)

    def projected(u: np.ndarray) -> np.ndarray:
        own = axes.get(u.shape[1])
        p = u[:, :GRID_DIMS] if own is None else u @ own
        return np.pad(p, ((0, 0), (0, GRID_DIMS - p.shape[1])))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = table.filter(pa.array(dims == dim))
                flat = own.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
                cells = np.floor(projected(units(flat.tobytes(), kind, dim)) / eps).astype(np.int32)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(int(dim) * int(kind[2])), len(cells), [None, pa.py_buffer(flat.tobytes())]).cast(pa.binary())
                listed = pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), GRID_DIMS).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), dim, np.int32)), listed, own.column("node").combine_chunks(), own.column("copies").combine_chunks(), raw], names=["dim", "cells", "node", "copies", "raw"])

    placed = durable(groups.select("dim", "node", "copies", "v").mapInArrow(place, "dim int, cells array<int>, node long, copies long, raw binary"))
    sizes = placed.agg(F.count("*").alias("n"), F.sum("dim").alias("cells")).first()
    if not sizes.n:
        spark = groups.sparkSession
        return spark.createDataFrame([], "node long, links long"), spark.createDataFrame([], "a long, b long")
    if interval is None:
        tasks = groups.sparkSession.sparkContext.defaultParallelism
        even = sizes.n / np.ceil((np.sqrt(8 * tasks + 1) - 1) / 2)  # as many pairs of intervals as cores
        interval = int(max(LEAST_INTERVAL, min(even, INTERVAL_CELLS * sizes.n / sizes.cells)))
    ordered = placed.repartitionByRange(max(1, -(-sizes.n // (4 * interval))), "dim", "cells", "node").sortWithinPartitions("dim", "cells", "node")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of the order, of one vector length and of ``interval`` vectors at most."""
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            edges = np.flatnonzero(np.diff(dims)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(dims)], strict=True):
                for at in range(lo, hi, interval):
                    own = batch.slice(at, min(interval, hi - at))
                    dim = int(dims[at])
                    raw = b"".join(own.column("raw").to_pylist())
                    p = projected(units(raw, kind, dim))
                    long = lambda c: own.column(c).to_numpy().astype("<i8").tobytes()  # noqa: B023, E731
                    values = [dim, part, seq, len(p), long("node"), long("copies"), raw, *p.min(0).tolist(), *p.max(0).tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in values], names=names)
                    seq += 1

    names = ["dim", "part", "seq", "n", "nodes", "copies", "raw", *LOW, *HIGH]
    kinds = "dim long, part long, seq long, n long, nodes binary, copies binary, raw binary, " + ", ".join(f"{c} double" for c in LOW + HIGH)
    pieces = durable(ordered.mapInArrow(cut, kinds))
    # A piece belongs to the interval in which it starts: vectors before it in its part, and in the parts before.
    within = F.coalesce(F.sum("n").over(Window.partitionBy("dim", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = F.coalesce(F.sum("part_n").over(Window.partitionBy("dim").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = pieces.groupBy("dim", "part").agg(F.sum("n").alias("part_n")).select("dim", "part", earlier.alias("before"))
    spots = pieces.select("dim", "part", "seq", "n", *LOW, *HIGH).withColumn("within", within).join(parts, ["dim", "part"])
    spots = durable(spots.withColumn("at", F.floor((F.col("before") + F.col("within")) / interval)).drop("before", "within", "n"))
    pairs = interval_pairs(durable(_boxes(spots, "dim", "at")), eps)
    sides = durable(pairs.select("dim", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("at")))
    loaded = sides.join(spots.select("dim", "part", "seq", "at"), ["dim", "at"]).join(pieces.select("dim", "part", "seq", "nodes", "copies", "raw"), ["dim", "part", "seq"])

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("seq", "ascending")])
        dim, a, b = (table.column(c)[0].as_py() for c in ("dim", "a", "b"))

        def side(at: int):
            own = table.filter(pa.array(table.column("at").to_numpy() == at))
            get = lambda c: b"".join(own.column(c).to_pylist())
            u = units(get("raw"), kind, dim)
            return np.frombuffer(get("nodes"), "<i8"), np.frombuffer(get("copies"), "<i8"), u, projected(u)

        na, ca, ua, pa_ = side(a)
        nb, cb, ub, pb = (na, ca, ua, pa_) if a == b else side(b)
        offset = 0 if a == b else len(na)
        nodes = na if a == b else np.concatenate((na, nb))
        count, parent = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        for a0, b0, near in interval_join(ua, pa_, ub, pb, a == b, cosine, eps):
            h, w = near.shape
            count[a0 : a0 + h] += near @ cb[b0 : b0 + w]
            count[offset + b0 : offset + b0 + w] += ca[a0 : a0 + h] @ near
            i, j = np.nonzero(near)
            join_roots(parent, a0 + i, offset + b0 + j)
        hit, child = np.flatnonzero(count), np.flatnonzero(parent != np.arange(len(nodes)))
        return pa.table(
            {
                "node": np.concatenate((nodes[hit], nodes[child])),
                "links": np.concatenate((count[hit], np.zeros(len(child), np.int64))),
                "root": np.concatenate((np.full(len(hit), -1), nodes[parent[child]])),
                "edge": np.arange(len(hit) + len(child)) >= len(hit),
            }
        )

    out = durable(loaded.groupBy("dim", "a", "b").applyInArrow(join, "node long, links long, root long, edge boolean"))
    links = out.filter("not edge").groupBy("node").agg(F.sum("links").alias("links"))
    return links, out.filter("edge").select(F.col("node").alias("a"), F.col("root").alias("b"))
