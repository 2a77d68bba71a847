"""SimHash near-duplicates by a self-join of binary tries.

A document's fingerprint is the bitwise majority of the XXH64 values of its word shingles.
Fingerprints within the Hamming budget are found by walking pairs of trie nodes together,
adding up the bits in which their paths differ and dropping a pair as soon as the budget is
exceeded. To spread the work, the 64 bits are cut into budget + 1 bands: two fingerprints
within the budget agree on one whole band at least, so for every band a trie that reads that
band first needs only the node pairs without any difference below the band. The tries under
one band value are joined in one task, groups of equal fingerprints having been collapsed
before. A task keeps a forest of the links it has found, skips node pairs that are
connected already and returns the forest only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import components, durable, join_roots

SEED = 42
BITS = 64
#: Node pairs with at most so many fingerprint pairs are compared directly.
LEAF_PAIRS = 16
#: Node pairs held at once by a walk.
WALK_PAIRS = 1 << 19


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of the A-Z lower-cased text's word shingles in order; none without words, one of a shorter text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    return np.array(hashes, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the A-Z lower-cased text's word shingles, repeats counted; 0 without words."""
    hashes = shingle_hashes(text, shingle)
    return majority(hashes) if len(hashes) else 0


def majority(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        h = hashes[part : part + (1 << 16)].astype("<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, fp long")


def trie_forest(keys: np.ndarray, start: np.ndarray, end: np.ndarray, depth: int, budget: int) -> np.ndarray:
    """Walk the tries of the intervals [start, end) of ``keys`` with themselves.

    Within an interval the keys are distinct, ascending and agree on the first ``depth``
    bits. Returns for each key the smallest index that links within the budget connect
    it with.
    """
    n = len(keys)
    parent = np.arange(n)
    wide = np.flatnonzero(end - start > 1)
    # Nodes are intervals: a_lo, a_hi, b_lo, b_hi, differing bits so far.
    todo = []
    size = np.cumsum(end[wide] - start[wide])
    for piece in np.split(wide, np.flatnonzero(np.diff(size // WALK_PAIRS)) + 1) if len(wide) else []:
        todo.append((depth, np.stack([start[piece], end[piece], start[piece], end[piece], np.zeros(len(piece), np.int64)])))
    while todo:
        at, nodes = todo.pop()
        if nodes.shape[1] > WALK_PAIRS:
            half = nodes.shape[1] // 2
            todo += [(at, nodes[:, half:]), (at, nodes[:, :half])]
            continue
        change = np.concatenate(([0], np.cumsum(parent[1:] != parent[:-1])))
        a0, a1, b0, b1, err = nodes
        joined = (change[a0] == change[a1 - 1]) & (change[b0] == change[b1 - 1]) & (parent[a0] == parent[b0])
        nodes = nodes[:, ~joined]
        a0, a1, b0, b1, err = nodes
        leaf = ((a1 - a0) * (b1 - b0) <= LEAF_PAIRS) | (at == BITS)
        if leaf.any():
            l0, l1, m0, m1, _ = nodes[:, leaf]
            count = (l1 - l0) * (m1 - m0)
            which = np.repeat(np.arange(len(count)), count)
            k = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            width = (m1 - m0)[which]
            i, j = l0[which] + k // width, m0[which] + k % width
            near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            join_roots(parent, i[near], j[near])
            a0, a1, b0, b1, err = nodes[:, ~leaf]
        if not len(a0):
            continue
        zeros = np.concatenate(([0], np.cumsum((keys >> np.uint64(BITS - 1 - at)) & np.uint64(1) == 0)))
        am, bm = a0 + zeros[a1] - zeros[a0], b0 + zeros[b1] - zeros[b0]
        same = a0 == b0
        children = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1)]
        children = [np.stack(c) for c in children] + [np.stack((am, a1, b0, bm, err + 1))[:, ~same]]
        below = np.concatenate(children, axis=1)
        below = below[:, (below[0] < below[1]) & (below[2] < below[3]) & (below[4] <= budget) & ~((below[0] == below[2]) & (below[1] - below[0] < 2))]
        if below.shape[1]:
            todo.append((at + 1, below))
    return parent


def links(nodes: DataFrame, budget: int = 3) -> DataFrame:
    """Forest edges (a, b) over ``nodes`` (fp, rep), fp distinct, that connect all rep whose fp differ in ``budget`` bits or fewer."""
    bands = budget + 1
    width = BITS // bands

    def rotated(band: int):
        shift = band * width
        fp = F.col("fp")
        return fp if not shift else F.shiftleft(fp, shift).bitwiseOR(F.shiftrightunsigned(fp, BITS - shift))

    keyed = nodes.select("rep", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), rotated(b).alias("key")) for b in range(bands)])).alias("k")).select("rep", "k.band", "k.key")
    dealt = keyed.repartition("band", F.shiftrightunsigned("key", BITS - width))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        rep, band, key = (table.column(c).to_numpy() for c in ("rep", "band", "key"))
        key = key.view(np.uint64)
        order = np.lexsort((key, band))
        rep, band, key = rep[order], band[order], key[order]
        top = key >> np.uint64(BITS - width)
        cut = np.flatnonzero((np.diff(band) != 0) | (np.diff(top) != 0)) + 1
        parent = trie_forest(key, np.concatenate(([0], cut)), np.concatenate((cut, [len(key)])), width, budget)
        child = np.flatnonzero(parent != np.arange(len(parent)))
        yield pa.RecordBatch.from_arrays([pa.array(rep[child]), pa.array(rep[parent[child]])], names=["a", "b"])

    return dealt.mapInArrow(work, "a long, b long")


def simhash_dedup(docs: DataFrame, shingle: int = 3, budget: int = 3) -> DataFrame:
    """Near-duplicate components of ``docs`` (doc_id, text; other columns are ignored).

    Returns one row per input row: doc_id, fingerprint (16 hex digits), component_id (the
    smallest doc_id that links of ``budget`` or fewer differing bits reach), kept (doc_id is
    the component_id). Null and word-less texts have fingerprint zero and link like any
    other. Repeated rows return repeatedly. doc_id names a document, rows that share one
    count as one document for links; rows with a null doc_id link nothing and get the
    component of their fingerprint, or null. An empty table gives an empty table.
    """
    prints = durable(fingerprints(docs, shingle))
    nodes = durable(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(nodes, budget))
    named = nodes.join(found, nodes.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
