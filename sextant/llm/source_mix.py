"""Mixing sources to target weights by hash-threshold histograms; DataFrame functions only.

Every document has a hash. Per source, words are summed by the leading bits of the hash;
the running sum finds the bucket in which the source's budget ends, and only that bucket is
cut further by the next bits, until the threshold is known to the last bit. A document is
then taken by comparing its hash with its source's threshold: nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import durable

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash that each histogram adds; they sum to 64.
LEVELS = (12, 13, 13, 13, 13)
SIGN = -(1 << 63)


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Adds ``target`` to ``sources`` (source, source_size).

    The weights go to the sources in code point order, null last, repeating. The targets
    share the sum of all sizes by weight but stop at ``most`` times their source's size; the
    excess is shared anew by weight until none is above.
    """
    placed = durable(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    rank = F.col("offset") + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = durable(placed.join(offsets, "part").select("source", "source_size", F.get(cycle, F.pmod(rank, F.lit(len(weights))).cast("int")).cast("double").alias("weight")))
    cap = F.lit(float(most)) * F.col("source_size")
    whole = weighed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    total = float(whole["words"] or 0)
    share = total / whole["weight"] if whole["weight"] else 0.0
    while True:
        full = cap <= F.col("weight") * F.lit(share)
        r = weighed.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("capped"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("free")).first()
        raised = (total - r["capped"]) / r["free"] if r["free"] else share
        if raised <= share:
            break
        share = raised
    return weighed.withColumn("target", F.least(cap, F.col("weight") * F.lit(share)))


def _key(seed: int):
    return F.xxhash64(F.lit(seed), "doc_id", F.col("text").cast("string"))


def _plan(docs: DataFrame, weights: tuple[int, ...], most: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The documents' (doc_id, source, size, key), and the plan: for each source its target and hash threshold.

    The plan is a written table, so a join with it is a broadcast where its size allows.
    """
    sized = durable(docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text").cast("string")).alias("size"), _key(seed).alias("key")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = F.round("target").cast("long")
    times = F.when(F.col("source_size") > 0, F.least(F.expr("goal div source_size"), F.lit(most))).otherwise(F.lit(0)).cast("long")
    budgets = source_targets(sources, weights, most).withColumn("goal", goal).withColumn("times", times)
    budgets = durable(budgets.select("source", "source_size", "target", "times", (F.col("goal") - F.col("times") * F.col("source_size")).alias("rest")))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    edge, bits = durable(budgets.filter("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("prefix"))), 0
    for more in LEVELS:
        b = edge.alias("b")
        inside = F.lit(True) if not bits else F.shiftrightunsigned("key", 64 - bits) == F.col("b.prefix")
        bucket = F.shiftrightunsigned("key", 64 - bits - more).bitwiseAND(F.lit((1 << more) - 1))
        counted = sized.filter("size > 0").alias("d").join(b, F.col("d.source").eqNullSafe(F.col("b.source")) & inside)
        counted = counted.groupBy("b.source", "b.rest", "b.prefix", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.min("key").alias("low"), F.max("key").alias("high"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        cut = counted.withColumn("upto", upto).filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
        edge = durable(cut.select("source", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"), F.shiftleft("prefix", more).bitwiseOR(F.col("bucket")).alias("prefix"), "words", "low", "high"))
        bits += more
        if edge.filter("low <> high").isEmpty():
            break
    edges = edge.select(F.col("source").alias("edge_source"), F.col("rest").alias("edge_rest"), F.col("words").alias("edge_words"), F.col("low").alias("edge"))
    plan = budgets.join(edges, budgets["source"].eqNullSafe(edges["edge_source"]), "left").select(*[F.col(c).alias(f"p_{c}") for c in budgets.columns], "edge_rest", "edge_words", "edge")
    return sized, durable(plan)


def _taken():
    """The words taken of a document (size, key) by its source's plan."""
    order = lambda c: F.col(c).bitwiseXOR(F.lit(SIGN))
    part = F.when(order("key") < order("edge"), F.col("size")).when(F.col("key") == F.col("edge"), F.floor(F.col("edge_rest") * F.col("size") / F.col("edge_words"))).otherwise(F.lit(0))
    return (F.col("p_times") * F.col("size") + F.coalesce(part, F.lit(0))).cast("long")


def source_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 42) -> DataFrame:
    """How many words of each document the mix takes.

    Returns doc_id, source, size (words; null text: 0), source_size, target (of the source),
    taken, one row per input row. Within a source every document is taken the same number of
    whole times and those below the hash threshold once more. The document on the threshold
    is cut, so that a source takes its rounded target to the word; rows that can't be told
    apart on the threshold share the cut evenly, rounded down. No document exceeds ``most``
    times its size. Null sources are a source of their own. Sources without words have
    target 0. An empty table gives an empty table. Other columns are ignored.
    """
    sized, plan = _plan(docs, weights, most, seed)
    out = sized.join(plan, sized["source"].eqNullSafe(plan["p_source"]))
    return out.select("doc_id", "source", "size", F.col("p_source_size").alias("source_size"), F.col("p_target").alias("target"), _taken().alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 42) -> DataFrame:
    """The documents of the mix, a row for each time that one is taken, with the columns of ``docs``.

    The last copy of a cut document has its first words, joined by one space, and its n_chars,
    where there is such a column, is theirs. Documents without words aren't taken.
    """
    _, plan = _plan(docs, weights, most, seed)
    rows = docs.select(F.struct("*").alias("row"), word_count(F.col("text").cast("string")).alias("size"), _key(seed).alias("key"))
    rows = rows.join(plan, F.col("row.source").eqNullSafe(plan["p_source"])).withColumn("taken", _taken()).filter("taken > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    rows = rows.withColumn("left", F.col("taken") - (F.col("copy") - 1) * F.col("size")).withColumn("cut", F.col("left") < F.col("size"))
    words = F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0))
    first = F.array_join(F.slice(words, F.lit(1), F.greatest("left", F.lit(1)).cast("int")), " ")
    rows = rows.withColumn("text", F.when(F.col("cut"), first).otherwise(F.col("row.text")))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("cut"), F.length("text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*[(F.col(f"row.`{c}`") if new.get(c) is None else new[c]).alias(c) for c in docs.columns])
