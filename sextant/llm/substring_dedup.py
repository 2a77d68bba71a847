"""Removal of repeated passages by FM-indexes, one per shard.

A window is ``window`` consecutive words of a document. So that all windows of one content
meet in one shard, a window goes where its anchor goes, the word group in it with the least
hash; the consecutive windows of a document with one anchor form a segment. Anchors in one
document only can't repeat a window of another and end there. Segments of equal content
are collapsed, with the smallest doc_id. Each shard builds an FM-index of its segments
and streams them through backward search: the matching statistics that reach ``window``
give the class of equal windows and with it the smallest document that has the window.
Anchors with very many different segments would fill a shard: their windows are dealt by
their own content instead, equal ones collapsed first. The intervals found return to the
documents, which are rewritten without the words that the intervals cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import durable
from sextant.llm.fm_index import FMIndex

#: Words of an anchor.
ANCHOR = 16
#: Words that a shard indexes, about.
SHARD_WORDS = 1 << 20
#: Different segments of an anchor above which its windows are dealt one by one.
BUSY = 4096
#: Texts handled at once.
TEXTS = 256
BASE = 0x9E3779B97F4A7C15
MIX = 0xBF58476D1CE4E5B9

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(MIX)
    return x ^ (x >> np.uint64(29))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to 0..n and its inverse, modulo 2 to the 64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, b, np.uint64))), dtype=np.uint64)
    return _powers[0], _powers[1]


def range_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the contents h[start:end], the same wherever they stand."""
    up, down = powers(len(h))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)))
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def segments(h: np.ndarray, lengths: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(document, start, windows, anchor, content) of the segments of documents joined in ``h``."""
    n, grams = len(h), window - ANCHOR + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    g, size = mixed(h), 1
    while size < ANCHOR:
        g = mixed(g[:-size] * np.uint64(BASE) + g[size:])
        size *= 2
    at, least, size = np.arange(len(g)), g, 1
    while size * 2 <= grams:
        take = least[size:] < least[:-size]
        least, at = np.where(take, least[size:], least[:-size]), np.where(take, at[size:], at[:-size])
        size *= 2
    if grams > size:
        k = grams - size
        take = least[k:] < least[:-k]
        least, at = np.where(take, least[k:], least[:-k]), np.where(take, at[k:], at[:-k])
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)[: len(at)]
    inside = np.flatnonzero(np.arange(len(at)) + window <= ends[doc])
    at, doc = at[inside], doc[inside]
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])))) if len(at) else none
    last = np.concatenate((first[1:], [len(at)])) if len(first) else none
    start, count = inside[first], last - first
    content = range_hashes(h, start, start + count + window - 1)
    return doc[first], start - (ends - lengths)[doc[first]], count, g[at[first]], content


def shard(rows: pa.Table, window: int) -> pa.RecordBatch:
    """Runs (key, sub, offset, windows, doc) of the shard's contents: from window ``offset`` on, the smallest document is ``doc``."""
    contents = [np.frombuffer(x.as_py(), dtype="<u8") for x in rows.column("words")]
    sizes = np.array([len(c) for c in contents])
    flat = np.concatenate(contents)
    ids = np.unique(flat, return_inverse=True)[1] + 1
    text, at = np.zeros(len(flat) + len(sizes), np.int64), np.cumsum(sizes) - sizes
    inside = np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)
    text[inside] = ids
    member = np.repeat(np.arange(len(sizes)), sizes + 1)
    index = FMIndex(text, window)
    docs = rows.column("doc").to_numpy()
    least = np.minimum.reduceat(docs[member[index.suffixes]], index.class_start)
    _, found = index.match(ids, at, at + sizes)
    place = np.flatnonzero(found >= 0)
    owner = np.repeat(np.arange(len(sizes)), sizes)[place]
    doc = least[found[place]]
    first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1]) | (np.diff(place) != 1)))) if len(place) else place
    count = np.diff(np.concatenate((first, [len(place)])))
    key, sub = rows.column("key").to_numpy(), rows.column("sub").to_numpy()
    own = owner[first]
    return pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(sub[own]), pa.array((place[first] - at[own]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(doc[first])], names=["key", "sub", "offset", "windows", "doc"])


def repeated_intervals(docs: DataFrame, window: int = 50) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, text) with a row key, and (row, start, end): words of the row that a smaller document has too."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(i, TEXTS)
                words = [words_of(t) for t in batch.column("text").to_pylist()]
                h = word_hashes([w for ws in words for w in ws])
                doc, start, count, anchor, content = segments(h, np.array([len(w) for w in words]), window)
                if len(doc):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), batch.column("doc_id").take(pa.array(doc)), batch.column("row").take(pa.array(doc)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))], names=["anchor", "content", "doc_id", "row", "start", "windows"])

    parts = durable(rows.filter("doc_id is not null and text is not null").mapInArrow(cut, "anchor long, content long, doc_id long, row long, start int, windows int"))
    # Written tables on both sides of these joins: only then can the adaptive skew join split a frequent anchor.
    shared = durable(parts.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("anchor"))
    parts = durable(parts.join(shared, "anchor"))
    contents = durable(parts.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "row", "start", "windows")).alias("f")).select("anchor", "content", "f.*"))
    busy = durable(contents.groupBy("anchor").agg((F.count("*") > BUSY).alias("busy")))
    wanted = contents.join(busy, "anchor").groupBy("row").agg(F.collect_list(F.struct("anchor", "content", "doc_id", "start", "windows", "busy")).alias("wanted"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "sub", "anchor", "content", "offset", "doc", "words"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        for batch in batches:
            out: list[tuple] = []
            windows: dict[tuple, tuple] = {}
            for text, wanted in zip(batch.column("text"), batch.column("wanted"), strict=True):
                h = word_hashes(words_of(text.as_py())).astype("<u8")
                for w in wanted.as_py():
                    start, stop = w["start"], w["start"] + w["windows"] + window - 1
                    if not w["busy"]:
                        out.append((w["anchor"], w["content"], None, None, 0, w["doc_id"], h[start:stop].tobytes()))
                        continue
                    at = np.arange(start, start + w["windows"])
                    own = range_hashes(h[start:stop], at - start, at - start + window)
                    again = range_hashes(mixed(h[start:stop]), at - start, at - start + window)
                    for k, (a, b) in enumerate(zip(own.view(np.int64).tolist(), again.view(np.int64).tolist(), strict=True)):
                        out.append((a, b, w["anchor"], w["content"], k, w["doc_id"], None))
                        if (a, b) not in windows or windows[a, b][0] > w["doc_id"]:
                            windows[a, b] = (w["doc_id"], h[start + k : start + k + window].tobytes())
            out += [(a, b, None, None, 0, doc, words) for (a, b), (doc, words) in windows.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names=names)

    loaded = durable(rows.select("row", "text").join(wanted, "row").select("text", "wanted").mapInArrow(load, "key long, sub long, anchor long, content long, offset int, doc long, words binary"))
    indexed = loaded.filter("words is not null").groupBy("key", "sub").agg(F.min(F.struct("doc", "words")).alias("f")).select("key", "sub", "f.*")
    total = loaded.agg(F.sum(F.length("words") / 8)).first()[0] or 0

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
        if size:
            yield shard(pa.Table.from_batches(held), window)

    found = durable(indexed.repartition(max(1, int(total // SHARD_WORDS) + 1), "key").mapInArrow(search, "key long, sub long, offset int, windows int, doc long"))
    owners = loaded.filter("words is null").select("key", "sub", "anchor", "content", F.col("offset").alias("at"))
    hits = found.select(F.col("key").alias("anchor"), F.col("sub").alias("content"), "offset", "windows", "doc").union(owners.join(found, ["key", "sub"]).select("anchor", "content", F.col("at") + F.col("offset"), "windows", "doc"))
    own = parts.select("anchor", "content", "doc_id", "row", "start")
    spans = own.join(hits, ["anchor", "content"]).filter("doc < doc_id")
    return rows, spans.select("row", (F.col("start") + F.col("offset")).alias("start"), (F.col("start") + F.col("offset") + F.col("windows") + window - 1).alias("end"))


def substring_dedup(docs: DataFrame, window: int = 50, with_text: bool = True) -> DataFrame:
    """Removes from every document the words in windows that a document of smaller doc_id has too.

    ``docs`` has doc_id and text; other columns are ignored. Words are separated by ASCII
    white space. Windows are judged on the input. Returns a row per input row: doc_id,
    n_words, n_removed, kept_sha256 (of the kept words joined by one space), intervals
    (start and end of the removed stretches, in words) and, with ``with_text``, text (the
    kept words). Null, empty and short texts lose nothing; null text has no words.
    Repeated rows return repeatedly and don't remove each other's words, as their doc_id
    isn't smaller; rows without a doc_id remove nothing and lose nothing. An empty table
    gives an empty table.
    """
    rows, spans = repeated_intervals(docs, window)
    spans = spans.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "intervals"] + ["text"] * with_text

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, TEXTS):
                batch, out = whole.slice(i, TEXTS), []
                for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                    words, at, kept, merged = words_of(text.as_py()), 0, [], []
                    for s in sorted((s["start"], s["end"]) for s in spans.as_py() or ()):
                        if merged and s[0] <= merged[-1]["end"]:
                            merged[-1]["end"] = max(merged[-1]["end"], s[1])
                        else:
                            merged.append({"start": s[0], "end": s[1]})
                    for s in merged:
                        kept += words[at : s["start"]]
                        at = s["end"]
                    left = b" ".join(kept + words[at:])
                    out.append((len(words), sum(s["end"] - s["start"] for s in merged), hashlib.sha256(left).hexdigest(), merged) + ((left.decode(),) if with_text else ()))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")] + [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=False)], names=names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, intervals array<struct<start:int,end:int>>" + ", text string" * with_text
    return rows.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(write, schema)
