"""The chunk index: an updatable table of chunks keyed by chunk_id.

On disk it is Parquet in hash buckets of doc_id, so that replacing or deleting a document
rewrites the buckets it lies in and nothing else. A change is written to a fresh folder; a
list of each bucket's folder, renamed into place at the end, makes it the index's state in
one step, so a change that fails halfway leaves the index as it was. One writer at a time:
two changes at once can lose one of them. Beside the chunks of each bucket lie their postings
(see ``lexical``), which change with them.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from sextant.functions.scratch import file_system
from sextant.operators.lexical import postings

BUCKETS = 64
#: Name of the lists of buckets; the highest number is the index's state.
STATE = "state-"
#: What an index without any chunk reads as.
CHUNKS = "chunk_id string, doc_id string, position int, text string"
#: Chunks of a file at most.
BATCH = 1 << 20
#: What the folders of postings end with.
TERMS = ".terms"


def upsert(base: DataFrame, new: DataFrame) -> DataFrame:
    """``base`` with the rows of ``new`` inserted or replacing those of the same chunk_id; the last of repeated new rows by ``position`` stays."""
    return base.join(new.select("chunk_id").distinct(), "chunk_id", "left_anti").unionByName(_last(new))


def _last(new: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("position")))
    return new.withColumn("_place", place).filter("_place = 1").drop("_place")


def delete_document(base: DataFrame, doc_id) -> DataFrame:
    return base.filter(~F.col("doc_id").eqNullSafe(F.lit(doc_id)))


def reindex(base: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of the documents in ``new`` give way to those of ``new``; repeated ones as with ``upsert``."""
    return base.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(_last(new))


def reindex_report(base: DataFrame, new: DataFrame) -> DataFrame:
    """Per document of ``new``: chunks written, chunks replaced, whether it was there."""
    before = base.groupBy("doc_id").agg(F.count("*").alias("n_old"))
    rows = new.groupBy("doc_id").agg(F.count("*").alias("n_chunks")).join(before, "doc_id", "left")
    return rows.select("doc_id", "n_chunks", F.coalesce("n_old", F.lit(0)).alias("n_replaced"), F.coalesce(F.col("n_old") > 0, F.lit(False)).alias("was_there"))


def list_documents(base: DataFrame) -> DataFrame:
    """Per document the name and kind of its first chunk, with defaults, and the number of chunks; by lower-case name."""
    first = lambda c, default: F.coalesce(F.min_by(c, "position"), F.lit(default)).alias(c)
    return base.groupBy("doc_id").agg(first("name", ""), first("kind", "documento"), F.count("*").alias("n_chunks")).orderBy(F.lower("name"), "doc_id")


def search_documents(documents: DataFrame, text: str) -> DataFrame:
    """Documents whose name or id holds ``text``, whatever its case."""
    return documents.filter(F.lower("name").contains(text.lower()) | F.lower(F.col("doc_id").cast("string")).contains(text.lower()))


def bucketed(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int"))


def _state(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """The number of the index's state and the folder of each bucket."""
    number, state = _read_state(spark, path)
    return number, state["buckets"]


def applied(spark: SparkSession, path: str) -> dict[str, int]:
    """The last batch of each stream that the index has had."""
    return _read_state(spark, path)[1]["applied"]


def _read_state(spark: SparkSession, path: str) -> tuple[int, dict]:
    folder, files = file_system(spark, path)
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    number = max((int(n.removeprefix(STATE)) for n in names if n.startswith(STATE)), default=0)
    if not number:
        return 0, {"buckets": {}, "applied": {}}
    return number, json.loads(spark.read.text(f"{path}/{STATE}{number}", wholetext=True).first()[0])


def _publish(spark: SparkSession, path: str, number: int, buckets: dict[str, str], batch: tuple[str, int] | None = None) -> None:
    """Make ``buckets`` the state after ``number``, with a stream's ``batch``; folders that neither it nor the one before names are removed."""
    target, files = file_system(spark, f"{path}/{STATE}{number + 1}")
    fresh, _ = file_system(spark, f"{path}/_new-{uuid.uuid4().hex}")
    out = files.create(fresh)
    out.write(bytearray(json.dumps({"buckets": buckets, "applied": applied(spark, path) | dict([batch] if batch else [])}).encode()))
    out.close()
    before = set(_state(spark, path)[1].values()) if number else set()
    if not files.rename(fresh, target):
        files.delete(fresh, False)
        raise RuntimeError(f"the index {path} has been changed meanwhile")
    for status in files.listStatus(target.getParent()):
        name = status.getPath().getName()
        if status.isDirectory() and name.removesuffix(TERMS) not in before | set(buckets.values()):
            files.delete(status.getPath(), True)


def _write(spark: SparkSession, path: str, rows: DataFrame, batch: int = BATCH) -> tuple[str, list[int], int]:
    """A fresh folder with ``rows`` in buckets, the buckets that it has, and how many rows; these are counted as they are written."""
    name, seen = f"data-{uuid.uuid4().hex}", Observation()
    counted = rows.repartition("bucket").observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.option("maxRecordsPerFile", batch).partitionBy("bucket").parquet(f"{path}/{name}")
    if "text" in rows.columns:
        chunks = spark.read.schema(rows.schema).parquet(f"{path}/{name}")
        postings(chunks, whole_buckets=True).sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/{name}{TERMS}")
    folder, files = file_system(spark, f"{path}/{name}")
    return name, [int(f.getPath().getName().removeprefix("bucket=")) for f in files.listStatus(folder) if f.isDirectory()], seen.get["rows"]


def write_index(chunks: DataFrame, path: str, batch: int = BATCH) -> int:
    """A new index, or a new state of an old one, in files of ``batch`` chunks at most; how many chunks it has."""
    if batch < 1:
        raise ValueError("batch must be at least 1")
    spark = chunks.sparkSession
    number, _ = _state(spark, path)
    name, buckets, written = _write(spark, path, bucketed(chunks), batch)
    _publish(spark, path, number, {str(b): name for b in buckets})
    return written


def open_index(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """The index's rows, or those of some ``buckets``; a change after this doesn't show in it."""
    number, state = _state(spark, path)
    if not number:
        raise FileNotFoundError(f"no index at {path}")
    every = {int(b): f"{path}/{name}/bucket={b}" for b, name in state.items()}
    folders = [folder for b, folder in sorted(every.items()) if buckets is None or b in buckets]
    if not folders:  # an empty index, or none of the buckets
        return spark.createDataFrame([], spark.read.parquet(next(iter(every.values()))).schema if every else CHUNKS)
    return spark.read.parquet(*folders)


def open_terms(spark: SparkSession, path: str) -> DataFrame:
    """The postings of the index's chunks, sorted by term in each bucket."""
    _, state = _state(spark, path)
    if not state:
        raise FileNotFoundError(f"no chunks in an index at {path}")
    every = [spark.read.parquet(f"{path}/{name}{TERMS}").filter(F.col("bucket").isin([int(b) for b in state if state[b] == name])) for name in sorted(set(state.values()))]
    return reduce(DataFrame.unionByName, every)


def delete_documents(spark: SparkSession, path: str, gone: DataFrame) -> None:
    """Remove all chunks of the documents in ``gone`` (doc_id) from the index on disk; only their buckets change."""
    number, state = _state(spark, path)
    if number:
        replace_documents(spark, path, open_index(spark, path).limit(0), changed=gone)


def replace_documents(spark: SparkSession, path: str, new: DataFrame, changed: DataFrame | None = None, batch: tuple[str, int] | None = None) -> None:
    """Reindex on disk: all chunks of the documents in ``changed`` (doc_id), or else of those in ``new``, give way to those of ``new``.

    Only the buckets of these documents are read, and written anew beside the old ones. The
    state names ``batch``, a stream and its batch, if there is one.
    """
    changed = (new if changed is None else changed).select("doc_id").distinct()
    hit = [r.bucket for r in bucketed(changed).select("bucket").distinct().collect()]  # at most BUCKETS
    number, state = _state(spark, path)
    if not hit:
        if batch:
            _publish(spark, path, number, state, batch)
        return
    rows = _last(new)
    if state:
        base = open_index(spark, path, hit)
        rows = base.join(changed, "doc_id", "left_anti").select(base.columns).unionByName(rows.select(base.columns))
    name, buckets, _ = _write(spark, path, bucketed(rows))
    kept = {b: folder for b, folder in state.items() if int(b) not in hit}
    _publish(spark, path, number, kept | {str(b): name for b in buckets}, batch)
