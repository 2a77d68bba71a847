"""Language-model scores: corpus counts and a gated recurrent network in numpy.

The counts of all training words come from one aggregation by 64-bit word hash. Then every
text is hashed once more and written as word ids, which training and scoring read. The network
knows the most frequent words, the end of a document and one token for all other words; it
starts as the unigram model of the counts and is trained in rounds: every partition runs
truncated backpropagation over its share of the training documents, and the parameters are
averaged by tokens. A document's log-likelihood carries the state from window to window over
the whole text; a word that the network doesn't know has the probability of the other-words
token times its share, by counts, of all such words. Counts of frequent words, a number
bounded by ``FREQUENT``, are broadcast; the others are joined by hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm import gru
from sextant.llm.common import durable, keep_memory

#: Words broadcast with their counts, at most.
FREQUENT = 400_000
#: Bins of counts or hashes in which the least frequent of these are searched.
BINS = 4096
#: One in so many training documents, by hash, trains the network in each of ``ROUNDS`` rounds; all of them in one of the two.
SHARE = 2
ROUNDS = 2
#: Tokens that a task counts, trains on or scores at once.
BLOCK = 1 << 21
FOLDS, HELD_OUT = 7, 2
#: Numbers that are kept of each row.
NUMBERS = ("row", "doc_id", "held_out", "turn", "n_tokens", "n_frequent", "n_other", "frequent_logs", "other_logs")
#: Hash of the end of a document; no word is empty.
END = xxhash.xxh3_64_intdigest(b"")


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT if doc_id is not None else False


def hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of the A-Z lower-cased text and of its end."""
    words = (text or "").encode().lower().split()
    words.append(b"")
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Lexicon:
    """Frequent words by hash: their counts and, of the most frequent, the network's ids."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        order = np.argsort(keys)
        self.keys, self.counts, self.total, self.distinct = keys[order], counts[order], total, distinct
        ranked = np.lexsort((self.keys, -self.counts))
        ranked = ranked[self.keys[ranked] != np.uint64(END)][: gru.WORDS - 2]
        self.ids = np.zeros(len(self.keys), np.int64)  # 0: the other words
        self.ids[ranked] = np.arange(len(ranked)) + 2
        self.ids[self.keys == np.uint64(END)] = 1
        known = self.ids > 0
        of_ids = np.zeros(gru.WORDS)
        of_ids[self.ids[known]] = self.counts[known]
        of_ids[0] = total - of_ids.sum()
        self.of_ids = of_ids
        #: Counts plus one of all other words, and one for those never seen.
        self.others = float(of_ids[0] + (distinct - int(known.sum())) + 1)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes and which are frequent."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return at, self.keys[at] == h


def _blocks(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and word hashes of the wanted documents, a bounded number of tokens at a time."""
    ids, held, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not wanted(doc_id):
                continue
            ids.append(doc_id)
            held.append(hashes(text.as_py()))
            size += len(held[-1])
            if size >= BLOCK:
                yield ids, held
                ids, held, size = [], [], 0
    if held:
        yield ids, held


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): counts by hash of all tokens of the training documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _blocks(batches, lambda d: not held_out(d)):
            words, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    return docs.mapInArrow(work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _least(values: DataFrame, high: int, want: int) -> tuple[int, int]:
    """The least value from which on ``values`` (c, from 0 to below ``high``) are at most ``want``, and how many those are.

    Bins from the highest on; the one that has too many is cut again until it is one value.
    """
    low, size = 0, 0
    while True:
        width = -(-(high - low) // BINS)
        own = values.filter((F.col("c") >= low) & (F.col("c") < high))
        steps = own.groupBy(F.expr(f"(c - {low}L) div {width}L").alias("bin")).agg(F.count("*").alias("rows")).orderBy(F.desc("bin")).collect()
        over = None
        for r in steps:
            if size + r.rows > want:
                over = r.bin
                break
            size += r.rows
        if over is None:
            return low, size
        if width == 1:
            return low + over + 1, size
        low, high = low + over * width, min(high, low + (over + 1) * width)


def lexicon(counts: DataFrame, frequent: int = FREQUENT) -> Lexicon:
    """The ``frequent`` words of the highest counts; of the count that can't stay whole, those of the highest hash."""
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.max("n").alias("most")).first()
    least, size = _least(counts.select(F.col("n").alias("c")), int(whole.most or 0) + 1, frequent)
    chosen = F.col("n") >= least
    if size < min(frequent, whole.v):
        place = F.shiftrightunsigned("word", 1)
        edge, _ = _least(counts.filter(F.col("n") == least - 1).select(place.alias("c")), (1 << 63) - 1, frequent - size)
        chosen |= (F.col("n") == least - 1) & (place >= edge)
    top = counts.filter(chosen).toArrow()
    return Lexicon(top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy(), int(whole.n or 0), int(whole.v))


def encoded(rows: DataFrame, lex: Lexicon, share: int) -> DataFrame:
    """The rows' word ids (two bytes each), sums over their frequent words and hashes of the others, written.

    ``turn`` is the round in which a training document trains.
    """
    known = rows.sparkSession.sparkContext.broadcast(lex)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        lex, row = known.value, TaskContext.get().partitionId() << 33
        for ids, held in _blocks(batches, lambda d: True):
            lengths = np.array([len(h) for h in held])
            flat = np.concatenate(held)
            at, frequent = lex.find(flat)
            owner = np.repeat(np.arange(len(held)), lengths)
            tokens = np.where(frequent, lex.ids[at] if len(lex.ids) else 0, 0)
            logs = np.where(frequent, np.log10((lex.counts[at] if len(lex.counts) else np.zeros(len(at))) + 1.0), 0.0)
            count = lambda mask: pa.array(np.bincount(owner[mask], minlength=len(held)).astype(np.int64))  # noqa: B023, E731
            total = lambda mask: pa.array(np.bincount(owner[mask], logs[mask], len(held)))  # noqa: B023, E731
            ends = np.concatenate(([0], np.cumsum(np.bincount(owner[~frequent], minlength=len(held))))).astype(np.int32)
            rares = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[~frequent].view(np.int64)))
            packed, cuts = tokens.astype("<u2").tobytes(), (np.concatenate(([0], np.cumsum(lengths))) * 2).tolist()
            every = np.ones(len(flat), bool)
            turns = [xxhash.xxh64_intdigest(str(d), 1) % share for d in ids]
            columns = [row + np.arange(len(held)), pa.array(ids, pa.int64()), [held_out(d) for d in ids], pa.array(turns, pa.int32()), count(every), count(frequent), count(tokens == 0), total(every), total(tokens == 0), [packed[x:y] for x, y in zip(cuts, cuts[1:], strict=False)], rares]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[*NUMBERS, "ids", "rare"])
            row += len(held)

    kinds = ["long", "long", "boolean", "int", "long", "long", "long", "double", "double"]
    schema = ", ".join(f"{name} {kind}" for name, kind in zip(NUMBERS, kinds, strict=True))
    return durable(rows.mapInArrow(work, f"{schema}, ids binary, rare array<long>"))


def _id_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches with their documents' ids, a bounded number of tokens at a time but for one longer document."""
    for batch in batches:
        lengths = np.asarray(pc.binary_length(batch.column("ids"))) // 2
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // BLOCK)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            part = batch.slice(lo, hi - lo)
            if hi > lo:
                yield part, [np.frombuffer(x.as_py(), "<u2").astype(np.int64) for x in part.column("ids")]


def train(texts: DataFrame, lex: Lexicon, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """The network after ``rounds`` rounds of training on ``encoded`` rows where they lie, and averaging."""
    params = gru.initial(lex.of_ids)
    names, shapes = list(params), {k: v.shape for k, v in params.items()}
    sc = texts.sparkSession.sparkContext
    for turn in range(rounds):
        shared = sc.broadcast(params)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            keep_memory()
            mine, total, waiting, size = None, 0, [], 0

            def flush(mine):
                return gru.fit(mine or shared.value, np.concatenate(waiting), 1)

            for _, docs in _id_blocks(batches):
                waiting += docs
                size += sum(map(len, docs))
                if size >= BLOCK:
                    mine, total, waiting, size = flush(mine), total + size, [], 0
            if size:
                mine, total = flush(mine), total + size
            if mine is not None:
                flat = np.concatenate([(mine[k] - shared.value[k]).ravel() for k in names]) * total
                size = 1 << 14
                parts = [flat[i : i + size].astype("<f4") for i in range(0, len(flat), size)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([total] * len(parts), pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["part", "tokens", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for part, tokens, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    x = np.frombuffer(x, "<f4")
                    sums[part] = [sums[part][0] + tokens, sums[part][1] + x] if part in sums else [tokens, x.astype(np.float64)]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([x.astype("<f4").tobytes() for _, x in sums.values()], pa.binary())], names=["part", "tokens", "sums"])

        kind = "part int, tokens long, sums binary"
        local = texts.filter(~F.col("held_out") & (F.col("turn") == turn)).select("ids").mapInArrow(work, kind)
        means = local.withColumn("salt", F.spark_partition_id() % 16).repartition("part", "salt").drop("salt").mapInArrow(add, kind).repartition("part").mapInArrow(add, kind)
        rows = sorted(means.collect(), key=lambda r: r.part)
        shared.destroy()
        if not rows:
            continue
        flat = np.concatenate([np.frombuffer(r.sums, "<f4") / r.tokens for r in rows])
        at, moved = 0, {}
        for k in names:
            n = int(np.prod(shapes[k]))
            moved[k] = params[k] + flat[at : at + n].reshape(shapes[k])
            at += n
        params = moved
    return params


def lm_scores(docs: DataFrame, share: int = SHARE, rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text; other columns are ignored).

    Documents whose crc32(doc_id as text) modulo 7 is 2 are held out of all learning. Null
    and empty texts are one token, the end. Returns doc_id, held_out, n_tokens, n_known
    (tokens that the training documents have), train_tokens, base_score (sum of log10 of
    add-one unigram shares) and score (the network's log10 probability of the text). Rows
    without a doc_id train; repeated rows count, train and return repeatedly. With no
    training tokens the network stays at its start. An empty table gives an empty table.
    Words are told apart by 64-bit hashes.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sc = docs.sparkSession.sparkContext
    counts = durable(word_counts(rows))
    lex = lexicon(counts, frequent)
    total, seen = lex.total, lex.distinct
    texts = encoded(rows, lex, share)
    params = sc.broadcast(train(texts, lex, rounds))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        for part, docs in _id_blocks(batches):
            net = gru.score(params.value, docs, 1) / np.log(10)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in NUMBERS), pa.array(net)], names=[*NUMBERS, "net"])

    numbers = texts.select(*NUMBERS)
    scored = texts.select(*NUMBERS, "ids").mapInArrow(work, numbers.withColumn("net", F.lit(0.0)).schema)
    each = texts.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    rare = each.join(counts.filter(F.col("n") <= (int(lex.counts.min()) if len(lex.counts) else 1 << 62)), "word").groupBy("row").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare_logs"))
    out = scored.join(rare, "row", "left")
    logs = F.coalesce("rare_logs", F.lit(0.0))
    base = F.col("frequent_logs") + logs - F.col("n_tokens") * F.lit(float(np.log10(total + seen + 1)))
    score = F.col("net") + F.col("other_logs") + logs - F.col("n_other") * F.lit(float(np.log10(lex.others)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_frequent") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
