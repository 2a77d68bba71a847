"""SimHash near-duplicates confirmed by the Jaccard similarity of word shingle sets.

Equal sets are one node. Candidates come from the trie self-join of SimHash fingerprints and,
since a 64-bit fingerprint can't carry a similarity of 0.8, from a second signature: nodes
that share one of ``BANDS`` keys of ``ROWS`` minimum hashes each; a pair of similarity s
shares none with a chance of (1 - s ** ROWS) ** BANDS, 5e-6 at 0.8. Under a key, every node
is compared with the least one only. Where that leaves the nodes of a key unconnected, their
sets are compared where the key's nodes meet, in blocks of bounded size, and only the links
that connect something leave the task, so large groups don't give all their pairs. Every
link is confirmed by the sets themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.llm.common import components, durable, trim_memory
from sextant.llm.simhash_dedup import links, majority, shingle_hashes

BANDS, ROWS = 40, 6
#: Nodes of one key that meet in one task: those of two blocks.
BLOCK = 512
#: Minimum hashes, a byte of each, by which a pair is estimated before its sets are; a pair of the similarity is this many deviations above the bound.
LANES, DEVIATIONS = 128, 4.5
#: Shingles whose hashes are permuted at once.
PART = 512
_RNG = np.random.default_rng(11)
TIMES = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)[:, None] | np.uint64(1)
PLUS = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)[:, None]


def band_keys(hashes: np.ndarray) -> list[int]:
    """The keys, as signed longs, of a set of shingle hashes; none of an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for part in range(0, len(hashes), PART):
        np.minimum(least, (TIMES * hashes[part : part + PART] + PLUS).min(1), out=least)
    return [_signed(xxhash.xxh64_intdigest(row.tobytes(), band)) for band, row in enumerate(least.reshape(BANDS, ROWS))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


SIGNATURE = T.StructType([*(T.StructField(name, T.LongType()) for name in ("node", "size", "fp")), T.StructField("keys", T.ArrayType(T.LongType()))])


@F.arrow_udf(SIGNATURE)
def signature(texts: pa.Array, shingles: pa.Array) -> pa.Array:
    """Of each text: hash and size of its shingle set, the set's SimHash fingerprint and its keys."""
    nodes, sizes, prints, keys = [], [], [], []
    for text, shingle in zip(texts, shingles, strict=True):
        found = np.unique(shingle_hashes(text.as_py(), shingle.as_py()))
        nodes.append(_signed(xxhash.xxh64_intdigest(found.tobytes())))
        sizes.append(len(found))
        prints.append(_signed(majority(found)) if len(found) else 0)
        keys.append(band_keys(found))
    trim_memory()
    return pa.StructArray.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["node", "size", "fp", "keys"])


@F.arrow_udf(T.ArrayType(T.LongType()))
def shingle_set(texts: pa.Array, shingles: pa.Array) -> pa.Array:
    """The set of each text as sorted hashes."""
    sets = [np.unique(shingle_hashes(t.as_py(), n.as_py())) for t, n in zip(texts, shingles, strict=True)]
    ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
    grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)))
    del sets
    trim_memory()
    return grams


def _alike(a, b, least: float):
    """Sets of sizes ``a`` and ``b`` can have the similarity."""
    return F.least(a, b) >= F.lit(least) * F.greatest(a, b)


def confirmed(sets: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose ``sets`` (node, grams) have a similarity of ``least`` or more."""
    x, y = sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    both = pairs.join(x, "a").join(y, "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    return durable(both.filter(F.col("both") >= F.lit(least) * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b"))


def lanes(sets: list[np.ndarray]) -> np.ndarray:
    """A byte of each of ``LANES`` minimum hashes of every set."""
    out = np.zeros((len(sets), LANES), np.uint8)
    for i, x in enumerate(sets):
        if len(x):
            least = np.full(LANES, np.iinfo(np.uint64).max, np.uint64)
            for part in range(0, len(x), PART):
                np.minimum(least, (TIMES[:LANES] * x[part : part + PART].astype(np.uint64) + PLUS[:LANES]).min(1), out=least)
            out[i] = (least >> np.uint64(40)).astype(np.uint8)
    return out


def connecting_links(sets: list[np.ndarray], components_: np.ndarray, block: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links of the similarity that connect different components; ``block`` is 0 or 1, and two blocks only meet across.

    A link joins its components only once the sets themselves have the similarity, so none
    that a true one would need is passed over.
    """
    n, sizes, across = len(sets), np.array([len(x) for x in sets]), len(np.unique(block)) > 1
    _, root = np.unique(components_, return_inverse=True)
    bytes_, bound = lanes(sets), least - DEVIATIONS * np.sqrt(least * (1 - least) / LANES)
    first, second, guess = [], [], []
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        fits = (root[j] != root[i]) & (np.minimum(sizes[j], sizes[i]) >= least * np.maximum(sizes[j], sizes[i]))
        j = j[fits & (block[j] != block[i]) if across else fits]
        share = (bytes_[j] == bytes_[i]).mean(1) if len(j) else np.zeros(0)
        j, share = j[share >= bound], share[share >= bound]
        first.append(np.full(len(j), i))
        second.append(j)
        guess.append(share)
    if not first:
        return []
    first, second, guess = np.concatenate(first), np.concatenate(second), np.concatenate(guess)
    out = []
    for k in np.argsort(-guess, kind="stable"):
        i, j = int(first[k]), int(second[k])
        if root[i] != root[j]:
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= least * (sizes[i] + sizes[j] - both):
                out.append((i, j))
                root[root == root[j]] = root[i]
    return out


def open_links(placed: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) of the similarity that connect components under a key, from ``placed`` (key, node, component)."""
    open_keys = placed.groupBy("key").agg((F.min("component") < F.max("component")).alias("open"), F.count("*").alias("n")).filter("open").select("key", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    met = placed.join(open_keys, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "component").join(sets, "node")

    def work(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        grams = table.column("grams").combine_chunks()
        found = np.split(grams.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(pc.list_value_length(grams).to_numpy(zero_copy_only=False))[:-1])
        pairs = connecting_links(found, table.column("component").to_numpy(), (table.column("own").to_numpy() != table.column("low").to_numpy()).astype(int), least)
        a, b = nodes[[i for i, _ in pairs]], nodes[[j for _, j in pairs]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return met.groupBy("key", "low", "high").applyInArrow(work, "a long, b long").distinct()


def near_components(texts: DataFrame, signed: DataFrame, shingle: int, least: float, budget: int) -> DataFrame:
    """(node, component) of the nodes of ``signed`` that links of ``least`` or more similarity connect with others.

    ``texts`` (doc_id, mark, text) are what is signed; only those of nodes that share a key are read again.
    """
    nodes = durable(signed.groupBy("node").agg(F.first("size").cast("int").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.min(F.struct("doc_id", "mark")).alias("row")))
    keys = nodes.select("node", "size", F.explode("keys").alias("key"))
    hubs = keys.groupBy("key").agg(F.min(F.struct("node", "size")).alias("hub"), F.count("*").alias("n")).filter("n > 1").select("key", "hub")
    shared = durable(keys.join(hubs, "key"))
    star = shared.filter(F.col("node") != F.col("hub.node")).filter(_alike(F.col("size"), F.col("hub.size"), least)).select(F.col("hub.node").alias("a"), F.col("node").alias("b"))
    reps = durable(nodes.groupBy("fp").agg(F.min("node").alias("rep")))
    same = nodes.join(reps, "fp").filter("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    trie = links(reps, budget).union(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = durable(star.union(trie).distinct())
    ends = first.select(F.col("a").alias("node")).union(first.select("b")).union(shared.select("node")).distinct()
    wanted = nodes.join(ends, "node").select("node", "row.*")
    found = texts.join(wanted, ["doc_id", "mark"]).groupBy("node").agg(F.first("text").alias("text"))
    sets = durable(found.select("node", shingle_set(F.col("text"), F.lit(shingle)).alias("grams")))
    near = confirmed(sets, first, least)
    linked = components(near)
    placed = durable(shared.select("key", "node").join(linked, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")))
    second = durable(open_links(placed, sets, least))
    return linked if second.isEmpty() else components(near.union(second))


def shingle_dedup(docs: DataFrame, shingle: int = 5, least: float = 0.8, budget: int = 3) -> DataFrame:
    """Rows of ``docs`` (doc_id, text and any others) that aren't near copies of a smaller doc_id.

    Documents whose sets of ``shingle``-word shingles (A-Z lower-cased; a shorter text is one
    shingle) have a Jaccard similarity of ``least`` or more are linked; of what links connect,
    the rows of the smallest doc_id stay. ``budget`` is the trie's, and decides only which
    candidates it gives. Rows are judged one by one, so of two texts with one doc_id the one
    without a copy of its own stays. Null and word-less texts are copies of each other. Rows
    without a doc_id can't be compared and stay. An empty table gives an empty table.
    """
    text = F.col("text").cast("string")
    mark = F.xxhash64(text)
    texts = docs.filter("doc_id is not null").select("doc_id", mark.alias("mark"), text.alias("text"))
    signed = durable(texts.select("doc_id", "mark", signature(F.col("text"), F.lit(shingle)).alias("s")).select("doc_id", "mark", "s.*"))
    found = near_components(texts, signed, shingle, least, budget)
    placed = signed.select("doc_id", "mark", "node").distinct().join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    roots = placed.groupBy("component").agg(F.min("doc_id").alias("root"))
    gone = placed.join(roots, "component").filter("doc_id <> root").select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark"))
    return docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["gone_mark"]), "left_anti")
