"""An inverted index of chunks for BM25, with block maxima by which most of it stays closed.

Chunks are dealt to blocks by hash. For each term and block that has it, the index holds the
postings, how many they are, the largest count and the smallest chunk: whatever the corpus'
mean size is or becomes, no chunk of the block can weigh more for the term than such a
posting would. A search adds up these bounds by question and block, opens the blocks of the
highest bounds first, and then all that can still reach the k-th score found: the result is
exact. Only postings of asked terms in opened blocks are read. They meet the block's questions
in one task, which returns the best chunks of each question only: single weights are never
shuffled.

The postings lie in buckets of their documents, so the index on disk changes with the chunks'
buckets (see ``index``); document frequencies and sizes are sums over the buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sextant.functions.scratch import durable
from sextant.functions.text import tokens, tokens_of

#: BM25 constants of the public library whose ranking is matched. Fixed values.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Chunks of a block on average, and blocks that a question opens before any floor is known.
BLOCK_CHUNKS, FIRST = 128, 4
#: Below this, two ways of adding up the same weights differ.
ROUNDING = 1e-7
#: Scores, or weights of questions, that a task holds at once.
CELLS = 1 << 21
#: The term under which a block's number of chunks and their words are kept; no token is empty.
ALL = ""


def postings(chunks: DataFrame, block_chunks: int = BLOCK_CHUNKS, whole_buckets: bool = False) -> DataFrame:
    """The index's rows of ``chunks`` (chunk_id, bucket, text): bucket, block, term, df, most, least, words, entries (chunk_id, tf, size).

    Chunks without text have none. ``most`` is the largest tf of the entries, ``least`` their
    smallest size, ``words`` the sum of their sizes. The row of term "" has all chunks of the
    block, but no entries. The texts are shuffled once, by block; a block is put together
    where its chunks arrive. With ``whole_buckets`` they are shuffled by bucket, so all rows
    of a bucket come from one task.
    """
    chunks = chunks.filter("text is not null").select("chunk_id", F.col("bucket").cast("int").alias("bucket"), "text")
    sizes = chunks.groupBy("bucket").agg(F.ceil(F.count("*") / block_chunks).alias("blocks"))
    placed = chunks.join(F.broadcast(sizes), "bucket")  # as many rows as there are buckets
    placed = placed.select("bucket", F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int").alias("block"), "chunk_id", "text")
    kind = to_arrow_type(chunks.schema["chunk_id"].dataType)
    schema = T._parse_datatype_string(f"bucket int, block int, term string, df long, most int, least int, words long, entries array<struct<chunk_id: {chunks.schema['chunk_id'].dataType.simpleString()}, tf: int, size: int>>")

    def block_rows(key: tuple[int, int], ids: list, words: list[list[str]]) -> pa.RecordBatch:
        size = np.array([len(w) for w in words], np.int64)
        coded = pa.array([t for w in words for t in w], pa.string()).dictionary_encode()
        pair, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), size), return_counts=True)
        term, row = pair // len(ids), pair % len(ids)
        begins = np.flatnonzero(np.diff(term, prepend=-1))
        over = lambda f, x, whole: np.append(f.reduceat(x, begins) if len(begins) else x[:0], whole)
        entries = pa.StructArray.from_arrays([pa.array(ids, kind).take(pa.array(row)), pa.array(tf, pa.int32()), pa.array(size[row], pa.int32())], names=["chunk_id", "tf", "size"])
        ends = np.concatenate((begins, [len(pair), len(pair)])).astype(np.int32)
        terms = [*coded.dictionary.to_pylist(), ALL]
        n = len(terms)
        columns = [pa.array([key[0]] * n, pa.int32()), pa.array([key[1]] * n, pa.int32()), pa.array(terms, pa.string()), pa.array(np.append(np.diff(ends)[:-1], len(ids)), pa.int64())]
        columns += [pa.array(over(np.maximum, tf, 1), pa.int32()), pa.array(over(np.minimum, size[row], size.min()), pa.int32()), pa.array(over(np.add, size[row], size.sum()), pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends), entries)], names=schema.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, words = None, [], []
        for batch in batches:
            for bucket, block, chunk_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, block) != last and ids:
                    yield block_rows(last, ids, words)
                    ids, words = [], []
                last = (bucket, block)
                ids.append(chunk_id)
                words.append(tokens_of(text))
        if ids:
            yield block_rows(last, ids, words)

    return placed.repartition(*["bucket"] if whole_buckets else ["bucket", "block"]).sortWithinPartitions("bucket", "block").mapInArrow(work, schema)


def _weight(tf: Column, size: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.lit(mean)))


class Search:
    """One search of ``questions`` (question_id, text) in written ``rows`` of the index."""

    def __init__(self, questions: DataFrame, rows: DataFrame):
        whole = rows.filter(F.col("term") == ALL).agg(F.sum("df").alias("n"), F.sum("words").alias("words")).first()
        n = float(whole.n or 0)
        self.rows, self.mean = rows, (whole.words or 0) / n if n else 1.0
        df = F.col("df")
        raw = rows.filter(F.col("term") != ALL).groupBy("term").agg(F.sum("df").alias("df")).select("term", (F.log(F.lit(n) - df + 0.5) - F.log(df + 0.5)).alias("raw"))
        raw = durable(raw)
        least = EPSILON * (raw.agg(F.avg("raw").alias("mean")).first().mean or 0.0)
        asked = questions.select("question_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("times"))
        #: The questions' words with their weights; a repeated word counts again.
        self.asked = durable(asked.join(raw, "term").select("question_id", "term", (F.col("times") * F.when(F.col("raw") < 0, F.lit(least)).otherwise(F.col("raw"))).alias("idf")))
        #: A number for each of them.
        self.terms = durable(self.asked.select("term").distinct().withColumn("number", F.monotonically_increasing_id()))

    def bounds(self) -> DataFrame:
        """question_id, bucket, block, bound: what no chunk of the block exceeds."""
        light = self.rows.select("bucket", "block", "term", "most", "least").join(self.asked, "term")
        most = F.greatest(F.lit(0.0), F.col("idf") * _weight(F.col("most"), F.col("least"), self.mean))
        return light.groupBy("question_id", "bucket", "block").agg(F.sum(most).alias("bound"))

    def opened(self, pairs: DataFrame, k: int) -> DataFrame:
        """question_id, chunk_id, score above zero in ``pairs`` (question_id, bucket, block): of each pair the ``k`` best chunks, and those that rounding can tie with them."""
        words = self.asked.join(self.terms, "term").groupBy("question_id").agg(F.collect_list(F.struct("number", "idf")).alias("words"))
        wanted = pairs.select("question_id", "bucket", "block").join(words, "question_id").select(F.col("bucket").alias("of_bucket"), F.col("block").alias("of_block"), "question_id", F.col("words.number").alias("numbers"), F.col("words.idf").alias("idfs"))
        hits = self.rows.select("bucket", "block", "term", "entries").join(self.terms, "term").join(pairs.select("bucket", "block").distinct(), ["bucket", "block"], "left_semi")
        hits = hits.select("bucket", "block", "number", *[F.col(f"entries.{c}").alias(c) for c in ("chunk_id", "tf", "size")])
        schema = T.StructType([pairs.schema["question_id"], T.StructField("chunk_id", hits.schema["chunk_id"].dataType.elementType), T.StructField("score", T.DoubleType())])
        kinds = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
        mean = self.mean

        def flat(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
            """The members of the lists, and whose they are."""
            lists = column.combine_chunks()
            return lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))

        def best(postings: pa.Table, questions: pa.Table) -> pa.Table:
            if not len(postings) or not len(questions):
                return kinds.empty_table()
            ids, row = flat(postings["chunk_id"])
            coded = ids.dictionary_encode()
            tf, size = (flat(postings[c])[0].to_numpy().astype(float) for c in ("tf", "size"))
            weights = np.zeros((len(postings), len(coded.dictionary)))
            weights[row, coded.indices.to_numpy()] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
            numbers = postings["number"].to_numpy()
            order = np.argsort(numbers)
            step, out = max(1, CELLS // max(weights.shape)), []
            for at in range(0, len(questions), step):
                some = questions.slice(at, step)
                asked, owner = flat(some["numbers"])
                asked, idf = asked.to_numpy(), flat(some["idfs"])[0].to_numpy()
                place = order[np.minimum(np.searchsorted(numbers, asked, sorter=order), len(order) - 1)]
                there = numbers[place] == asked
                used, column = np.unique(place[there], return_inverse=True)
                of = np.zeros((len(some), len(used)))
                of[owner[there], column] = idf[there]
                scores = of @ weights[used]
                floor = np.partition(scores, -k, 1)[:, -k, None] - ROUNDING if scores.shape[1] > k else -np.inf
                q, c = np.nonzero((scores > 0) & (scores >= floor))
                out.append(pa.Table.from_arrays([some["question_id"].take(pa.array(q)), coded.dictionary.take(pa.array(c)), pa.array(scores[q, c])], schema=kinds))
            return pa.concat_tables(out)

        found = hits.groupBy("bucket", "block").cogroup(wanted.groupBy("of_bucket", "of_block")).applyInArrow(best, schema)
        return found.withColumn("score", F.round("score", 8)).filter("score > 0")

    def plan(self, k: int, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
        """What the first blocks give, and the other (question_id, bucket, block) that have to be opened."""
        bounds = durable(self.bounds().withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("bound"), "bucket", "block"))))
        seen = durable(self.opened(bounds.filter(F.col("place") <= first), k))
        place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score")))
        floors = seen.withColumn("place", place).filter(F.col("place") == k).select("question_id", F.col("score").alias("floor"))
        rest = bounds.filter(F.col("place") > first).join(floors, "question_id", "left")
        return seen, rest.filter(F.col("bound") >= F.coalesce("floor", F.lit(0.0)) - ROUNDING)


def search_terms(questions: DataFrame, rows: DataFrame, k: int = 5, first: int = FIRST) -> DataFrame:
    """The ``k`` best chunks of each question by BM25, scores above zero, ties by chunk_id: question_id, chunk_id, score, rank."""
    search = Search(questions, rows)
    seen, rest = search.plan(k, first)
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    return seen.union(search.opened(rest, k)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bm25(questions: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """Top chunks (chunk_id, text) by BM25 for each question (question_id, text), by an index written for this search."""
    return search_terms(questions, durable(postings(chunks.select("chunk_id", F.lit(0).alias("bucket"), "text"))), k)
