"""How filters of a corpus interact: what each removes, in every order in which they may be applied.

A document's failures are a mask of five bits, and everything is counted from the masks by
part. Whether an earlier document has the same text is found by partition refinement: rows
are split by length in code points, then by the hashes of successive blocks of text, and
whoever is alone in a class drops out. What is left is compared by whole texts. DataFrame
functions only.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import discard, durable

LETTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 2, r"[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"
#: Code points of the successive blocks; the last one holds the rest.
BLOCKS = (64, 448, 3584)
#: Classes of equal hashes, 40 bytes each, up to which they are sent to the texts; beyond, both are shuffled by class.
BROADCAST_CLASSES = 1 << 20
#: Letters by bit, and the order of the filters that a step can find before it.
BIT = {c: 1 << k for k, c in enumerate(LETTERS)}


def block_hashes(text: Column, blocks: tuple[int, ...] = BLOCKS, bits: int = 64) -> list[Column]:
    """Hashes of a text's successive blocks; ``bits`` keeps only so many of each, for tests."""
    begins = [sum(blocks[:k]) for k in range(len(blocks) + 1)]
    sizes = [*(F.lit(n) for n in blocks), F.length(text)]
    hashed = (F.xxhash64(F.substring(text, F.lit(at + 1), n)) for at, n in zip(begins, sizes, strict=True))
    return [F.shiftrightunsigned(h, 64 - bits) if bits < 64 else h for h in hashed]


def _texts(docs: DataFrame, bits: int) -> tuple[DataFrame, list[str]]:
    """doc_id, part, text and the classes by which texts are split, coarse to fine."""
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    names = ["size", *(f"block{k}" for k in range(len(BLOCKS) + 1))]
    return rows.select("*", F.length("text").alias("size"), *(h.alias(n) for h, n in zip(block_hashes(F.col("text"), bits=bits), names[1:], strict=True))), names


def _failures(rows: DataFrame) -> DataFrame:
    """``rows`` (text, size) with ``mask``, the bits of A to D, instead of text."""
    words = rows.select("*", F.array_remove(F.split("text", SPACES, -1), "").alias("words"))
    n, different = F.size("words"), F.size(F.array_distinct("words"))
    fails = {
        "A": n < LEAST_WORDS,
        "B": 100 * different < DISTINCT_PERCENT * n,
        "C": 100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > CAPITAL_PERCENT * F.col("size"),
        "D": F.col("text").rlike(SYMBOLS),
    }
    mask = sum((F.when(f, BIT[c]).otherwise(0) for c, f in fails.items()), F.lit(0))
    return words.select(*(c for c in rows.columns if c != "text"), mask.cast("int").alias("mask"))


def _shared_classes(facts: DataFrame, names: list[str]) -> DataFrame:
    """The classes of more than one row after all refinements; each round reads only the rows that the one before left together."""
    live = None
    for k in range(1, len(names) + 1):
        rows = facts.select(names) if live is None else live
        many = rows.groupBy(*names[:k]).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
        if k == len(names):
            classes = durable(many)
            discard(live)
            return classes
        kept = durable(rows.join(many, names[:k], "left_semi"))
        if live is not None:
            discard(live)
        live = kept


def _among(rows: DataFrame, classes: DataFrame, names: list[str]) -> DataFrame:
    """Rows whose class is one of the written ``classes``; few enough are sent to the rows."""
    few = classes.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES
    return rows.join(F.broadcast(classes) if few else classes, names, "left_semi")


def _with_copies(docs: DataFrame, bits: int) -> DataFrame:
    """doc_id, part and mask of every row, the bit of E for those whose text a smaller doc_id has."""
    texts, names = _texts(docs, bits)
    facts = durable(_failures(texts))
    classes = _shared_classes(facts, names)
    least = lambda rows: rows.groupBy(*names, "text").agg(F.min("doc_id").alias("first"))
    compared = least(_among(texts, classes, names)).groupBy(*names).agg(F.count("*").alias("texts"), F.min("first").alias("first"))
    compared = durable(compared)
    later = lambda first: F.when(F.col("doc_id") > first, F.col("mask").bitwiseOR(F.lit(BIT["E"]))).otherwise(F.col("mask")).alias("mask")
    own = compared.select(*(F.col(c).alias(f"of_{c}") for c in names), "first", "texts")
    same = [F.col(c) == F.col(f"of_{c}") for c in names]
    out = facts.join(own, same, "left")
    marked = out.filter("texts is null or texts = 1").select("doc_id", "part", later(F.col("first")))
    mixed = durable(compared.filter("texts > 1").select(*names))
    if mixed.isEmpty():
        return marked
    # Different texts share all hashes: their rows are told apart by text.
    rows = _among(texts, mixed, names)
    first = least(rows).select(*(F.col(c).alias(f"of_{c}") for c in (*names, "text")), "first")
    apart = rows.join(first, [F.col(c) == F.col(f"of_{c}") for c in (*names, "text")]).select("doc_id", "part", "text", "size", "first")
    return marked.union(_failures(apart).select("doc_id", "part", later(F.col("first"))))


def _marginals(counts: DataFrame) -> DataFrame:
    """What a filter does to a part after a set of others, from counts (part, mask, n, good, toxic).

    One row for each part, filter bit and set ``before``; ``shapley`` is the filter's share
    of this set, weighed by the orders that have it.
    """
    cases = [(BIT[c], before) for c in LETTERS for before in range(32) if not before & BIT[c]]
    weight = {b: factorial(k := bin(b).count("1")) * factorial(len(LETTERS) - 1 - k) for _, b in cases}
    each = F.array(*(F.struct(F.lit(bit).alias("bit"), F.lit(before).alias("before"), F.lit(weight[before]).cast("long").alias("orders")) for bit, before in cases))
    rows = counts.withColumn("c", F.explode(each)).select("part", "mask", "n", "good", "toxic", "c.*")
    hit = F.col("mask").bitwiseAND(F.col("bit")) != 0
    free = F.col("mask").bitwiseAND(F.col("before")) == 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    return rows.groupBy("part", "bit", "before", "orders").agg(
        total(free & ~hit).alias("kept"),
        total(free & hit).alias("removed"),
        total(~free & hit).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(free & hit, "good").alias("good_lost"),
        total(free & hit, "toxic").alias("toxic_lost"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, bits: int = 64) -> DataFrame:
    """What each of the filters A to E does, in each of their orders, to each part of ``docs``.

    ``docs`` has doc_id, text and source, ``labels`` doc_id, quality and toxic; other columns
    are ignored. A: under 200 words; B: less than half of the words are different; C: over 2 %
    of the code points are capitals; D: one of six symbols; E: a smaller doc_id has the same
    text. Returns part, filter_order, step and, of the step's filter: kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley; a row for every part, order and
    step.

    A null text is empty, a null source the part "". Rows without a doc_id are no one's
    copy and have no labels; rows with equal doc_id and text aren't each other's copies.
    Repeated rows count repeatedly; of a document labelled several times any label counts.
    An empty table gives an empty table.
    """
    marked = _with_copies(docs, bits)
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = marked.join(known, F.col("doc_id") == F.col("of"), "left")
    number = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    counts = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), number("good"), number("toxic"))
    found = durable(_marginals(counts))
    shares = found.groupBy(F.col("part").alias("of_part"), F.col("bit").alias("of_bit")).agg(F.sum(F.col("removed") * F.col("orders")).cast("long").alias("shapley"))
    steps = [(o, k + 1, BIT[c], sum(BIT[x] for x in o[:k])) for o in map("".join, permutations(LETTERS)) for k, c in enumerate(o)]
    table = F.broadcast(docs.sparkSession.createDataFrame(steps, "filter_order string, step int, at_bit int, at_before int"))
    out = found.join(table, (F.col("bit") == F.col("at_bit")) & (F.col("before") == F.col("at_before")))
    out = out.join(shares, (F.col("part") == F.col("of_part")) & (F.col("bit") == F.col("of_bit")))
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


ORACLE = r"""
WITH known AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
failed AS (
  SELECT doc_id, part, concat(
    CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END,
    CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END,
    CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' ELSE '' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
    CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails FROM texts),
counts AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failed LEFT JOIN known USING (doc_id) GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
  SELECT concat(a.c, b.c, d.c, e.c, f.c) AS filter_order FROM letters a, letters b, letters d, letters e, letters f
  WHERE len(list_distinct([a.c, b.c, d.c, e.c, f.c])) = 5),
steps AS (SELECT filter_order, CAST(k AS INTEGER) AS step, substr(filter_order, CAST(k AS INTEGER), 1) AS c, substr(filter_order, 1, CAST(k AS INTEGER) - 1) AS before FROM orders, range(1, 6) r(k)),
each AS (
  SELECT part, filter_order, step, c, n, good, toxic, contains(fails, c) AS hit, length(translate(fails, before, '')) = length(fails) AS free, fails = c AS alone
  FROM counts, steps),
done AS (
  SELECT part, filter_order, step, c,
    coalesce(sum(n) FILTER (free AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (free AND hit), 0) AS removed,
    coalesce(sum(n) FILTER (NOT free AND hit), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
    coalesce(sum(good) FILTER (free AND hit), 0) AS good_lost, coalesce(sum(toxic) FILTER (free AND hit), 0) AS toxic_lost
  FROM each GROUP BY part, filter_order, step, c)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM done"""
