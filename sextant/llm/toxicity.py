"""Toxic spans and documents by a linear-chain conditional random field.

Tokens are runs of letters. Their labels come from the documents' labels: a token of a toxic
document is toxic if it has a stem that training documents show to go with toxicity, by the
likelihood ratio of the documents that hold it and by how often it occurs in them. Stems are
whole words and beginnings of words, so forms never seen are found by their stem. The field
learns weights of stems and of neighbouring labels; marginals of the forward-backward pass,
over whole texts, give offsets, and their sum, share and maximum a document's score.

What is learned comes from a bounded sample of the labelled rows, one document of each sketch
of its shingles, so copies don't count as evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm import crf
from sextant.llm.common import discard, durable, keep_memory, trim_memory

FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
#: Bytes of text that are learned from at most, in expectation over the hash, half of them toxic; tokens that train the field; stems that it has.
TRAIN_BYTES, TRAIN_TOKENS, STEMS = 1 << 24, 1 << 20, 4096
#: Bytes that a row counts for besides its text, so that short texts are bounded too.
ROW_BYTES = 64
#: Letters of a word's beginnings. Times as often that a stem occurs among the words of toxic documents as among others.
BEGINNINGS, OFTEN = (8, 7, 6, 5, 4, 3), 4.0
LEAST_DOCUMENTS = 3
SHINGLE = 3
WORD = re.compile(r"[^\W\d_]+")
#: Code points cut into words at once, tokens worked on at once, words whose kinds a task keeps, letters of such a word.
SLICE, BLOCK, KEPT_WORDS, KEPT_LETTERS = 1 << 20, 1 << 20, 1 << 19, 64
#: A token from this marginal on is part of a toxic span; one below the other doesn't count, or long texts would add up to something.
SPAN, FAINT = 0.5, 0.1


def held_out_fold(doc_id):
    """Rows without a doc_id are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def stems(word: str) -> list[str]:
    """Whole word (marked), then beginnings, longest first."""
    word = word.lower()
    return [word + "$", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


def slices(text: str) -> Iterator[tuple[int, str]]:
    """A text in pieces that don't cut a word, with where they begin."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text) and (run := WORD.match(text, end)):
            end = run.end()
        yield at, text[at:end]
        at = end


class Kinds(dict):
    """The kind of each word: the place of its longest known stem, from 1; 0 if it has none."""

    def __init__(self, known: list[str]):
        super().__init__()
        self.places = {s: i + 1 for i, s in enumerate(known)}

    def __missing__(self, word: str) -> int:
        kind = next((self.places[s] for s in stems(word) if s in self.places), 0)
        if len(word) <= KEPT_LETTERS:
            self[word] = kind
        return kind

    def of(self, text: str | None) -> np.ndarray:
        if len(self) > KEPT_WORDS:
            self.clear()
        found = [np.array([self[w] for w in WORD.findall(piece)], np.int16) for _, piece in slices(text or "")]
        return np.concatenate(found) if found else np.zeros(0, np.int16)


def chains(known: list[str]) -> list[np.ndarray]:
    """The stems that a kind has: its own and those among the beginnings of it."""
    places = {s: i for i, s in enumerate(known)}
    return [np.zeros(0, np.int64)] + [np.array([places[s], *(places[b] for b in stems(s.rstrip("$")) if b in places and b != s and not b.endswith("$"))]) for s in known]


def spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Offsets of the runs of tokens that ``hit`` has."""
    out, i, open_ = [], 0, False
    for at, piece in slices(text):
        for m in WORD.finditer(piece):
            if hit[i]:
                start = out.pop()[0] if open_ else at + m.start()
                out.append((start, at + m.end()))
            open_ = bool(hit[i])
            i += 1
    return out


def summary(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What a document's score looks at: a function of the sum, the share and the maximum of its tokens' marginals."""
    out = np.zeros((len(sizes), 4))
    out[:, 0] = 1.0
    full = np.flatnonzero(sizes)
    if len(full):
        begins = (np.cumsum(sizes) - sizes)[full]
        total = np.add.reduceat(np.where(p < FAINT, 0.0, p), begins)
        out[full, 1], out[full, 2], out[full, 3] = np.log1p(total), np.log1p(100 * total / sizes[full]), np.maximum.reduceat(p, begins)
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, pull: float = 0.1) -> np.ndarray:
    """Weights of a logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - pull * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        w += np.clip(np.linalg.solve(curve, slope), -4, 4)
    return w


class ToxicityModel:
    """Stems, the field over their kinds, and the weights of a document's summary."""

    def __init__(self, known: list[str], field: crf.Field, weights: np.ndarray):
        self.known, self.field, self.weights = known, field, weights

    def score(self, p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary(p, sizes) @ self.weights, -30, 30)))


def _marginals(field: crf.Field, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' marginals of documents, laid end to end, and the documents' sizes."""
    sizes = np.array([len(h) for h in held])
    begins = np.cumsum(sizes) - sizes
    return crf.marginals(field, np.concatenate(held), begins[sizes > 0]), sizes


def sketch(texts):
    """The least hash of a text's shingles, an Arrow UDF; near copies mostly share it."""

    @F.arrow_udf("long")
    def least(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for text in batch:
                words = (text.as_py() or "").lower().split()
                h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
                each = np.zeros(max(1, len(h) - SHINGLE + 1), np.uint64)
                for k in range(min(SHINGLE, len(h))):
                    each = (each ^ h[k : k + len(each)]) * np.uint64(0x9E3779B97F4A7C15)
                    each ^= each >> np.uint64(29)
                out.append(int(each.min().view(np.int64)))
            yield pa.array(out, pa.int64())

    return least(texts)


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic, weight, text of what is learned from, written; a row's weight is the inverse of its label's share."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most and toxic in (0, 1)")
    known = durable(known.filter(~held_out_fold(F.col("_id"))).select("_id", "toxic", (F.shiftrightunsigned(F.xxhash64("_id"), 1) / F.lit(2.0**63)).alias("place")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = rows.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).alias("bytes")).join(known, F.col("doc_id") == F.col("_id")).groupBy("toxic").agg(F.sum("bytes").alias("bytes")).collect()
    shares = {r.toxic: min(1.0, TRAIN_BYTES / 2 / max(1, r.bytes or 0)) for r in sizes}
    share = F.when(F.col("toxic") == 1, shares.get(1, 1.0)).otherwise(shares.get(0, 1.0))
    wanted = known.withColumn("share", share).filter("place < share")
    few = rows.join(F.broadcast(wanted) if wanted.limit(TRAIN_BYTES // ROW_BYTES).count() < TRAIN_BYTES // ROW_BYTES else wanted, F.col("doc_id") == F.col("_id"))
    few = durable(few.select("doc_id", F.col("toxic").cast("int").alias("toxic"), (1 / F.col("share")).alias("weight"), "text"))
    one = few.withColumn("sketch", sketch(F.col("text"))).groupBy("sketch").agg(F.min(F.struct("doc_id", "toxic", "weight", "text")).alias("row"))
    out = durable(one.select("row.*"))
    discard(known)
    discard(few)
    return out


def _stem_counts(sample: DataFrame) -> DataFrame:
    """stem, and of documents of label 0 and 1: how many have it (d0, d1) and how often they do (n0, n1)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [Counter() for _ in range(4)]
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = Counter(w for _, piece in slices(text.as_py() or "") for w in WORD.findall(piece))
                every = Counter()
                for w, n in words.items():
                    for s in stems(w):
                        if len(s) <= KEPT_LETTERS:
                            every[s] += n
                sums[toxic].update(every.keys())
                sums[2 + toxic].update(every)
            trim_memory()
        names = list(sums[0].keys() | sums[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[s] for s in names], pa.int64()) for c in sums)], names=["stem", "d0", "d1", "n0", "n1"])

    counted = sample.select("toxic", "text").mapInArrow(work, "stem string, d0 long, d1 long, n0 long, n1 long")
    return counted.groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("d0", "d1", "n0", "n1")])


def toxic_stems(sample: DataFrame) -> list[str]:
    """The stems that go with label 1, by likelihood ratio, the strongest first.

    The ratio has to exceed what the best of so many unrelated stems would reach.
    """
    docs = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(docs) < 2:
        return []
    counts = durable(_stem_counts(sample))
    often = counts.filter(F.col("d0") + F.col("d1") >= LEAST_DOCUMENTS)
    whole = often.agg(F.count("*").alias("tested"), F.sum(F.when(F.col("stem").endswith("$"), F.col("n0"))).alias("n0"), F.sum(F.when(F.col("stem").endswith("$"), F.col("n1"))).alias("n1")).first()
    d = [F.col("d0").cast("double"), F.col("d1").cast("double")]
    n = sum(docs.values())
    held, lacking = d[0] + d[1], n - d[0] - d[1]
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    ratio = 2 * sum((part(d[k], held * docs[k] / n) + part(docs[k] - d[k], lacking * docs[k] / n) for k in (0, 1)), F.lit(0.0))
    often_in = F.col("n1") / F.lit(float(max(1, whole.n1 or 0))) >= OFTEN * F.greatest(F.col("n0"), F.lit(0.5)) / F.lit(float(max(1, whole.n0 or 0)))
    best = often.filter((F.col("d1") >= LEAST_DOCUMENTS) & often_in).withColumn("ratio", ratio).filter(F.col("ratio") > 2 * np.log(max(2, whole.tested)))
    found = [r.stem for r in best.orderBy(F.desc("ratio"), "stem").limit(STEMS).collect()]
    discard(counts)
    return found


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The model of the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) mark one way and that aren't held out."""
    sample = _sample(docs, labels)
    known = toxic_stems(sample)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = Kinds(shared.value)
        for batch in batches:
            each = [kinds.of(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), batch.column("weight"), pa.array(each, pa.binary())], names=["doc_id", "toxic", "weight", "kinds"])

    rows = sample.mapInArrow(work, "doc_id long, toxic int, weight double, kinds binary").orderBy(F.xxhash64("doc_id"), "doc_id", "kinds").collect()
    shared.destroy()
    discard(sample)
    held = [np.frombuffer(r.kinds, np.int16) for r in rows]
    toxic = np.array([r.toxic for r in rows], float)
    weight = np.array([r.weight for r in rows])
    if not held:
        return ToxicityModel([], crf.Field(np.zeros(1)), np.zeros(4))
    sizes = np.array([len(h) for h in held])
    upto = max(1, int((np.cumsum(sizes) <= TRAIN_TOKENS).sum()))
    kinds, own = np.concatenate(held[:upto]), sizes[:upto]
    begins = (np.cumsum(own) - own)[own > 0]
    field = crf.fit(kinds, begins, (kinds > 0) * np.repeat(toxic[:upto], own), chains(known)) if known else crf.Field(np.full(1, -crf.REACH))
    p, sizes = _marginals(field, held)
    return ToxicityModel(known, field, logistic(summary(p, sizes), toxic, weight / weight.mean()))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and spans (start, end) of every row.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic; other columns are ignored.
    Rows whose crc32(doc_id as text) modulo 3 is 1 are held out of all learning, rows without
    a doc_id too. ``spans`` are offsets in code points, the end exclusive, of the runs of
    tokens that are toxic with a probability of one half or more. Null and empty texts have
    no spans and the score of a text without toxic words. Documents that are labelled both
    ways aren't learned from. Repeated rows return repeatedly. If the training rows have one
    label only, all texts get the same score, and 0.5 if there are none. An empty table gives
    an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        model = shared.value
        kinds = Kinds(model.known)

        def scored(ids: list, texts: list, held: list) -> pa.RecordBatch:
            p, sizes = _marginals(model.field, held)
            ends = np.cumsum(sizes)
            high = p >= SPAN
            some = np.add.reduceat(np.append(high, False), np.minimum(ends - sizes, len(p))) * (sizes > 0)
            found = [[{"start": a, "end": b} for a, b in spans(t, high[e - n : e])] if s else [] for t, n, e, s in zip(texts, sizes, ends, some, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(model.score(p, sizes)), pa.array(found, kind)], names=["doc_id", "score", "spans"])

        for batch in batches:
            ids, texts, held, size = [], [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                texts.append(text.as_py())
                held.append(kinds.of(texts[-1]))
                size += len(held[-1])
                if size >= BLOCK:
                    yield scored(ids, texts, held)
                    ids, texts, held, size = [], [], [], 0
            if held:
                yield scored(ids, texts, held)
        trim_memory()

    out = rows.mapInArrow(work, "doc_id long, score double, spans array<struct<start:long,end:long>>")
    return out.select("doc_id", held_out_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
