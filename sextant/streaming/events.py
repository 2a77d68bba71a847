"""Uploads and deletions of documents as a stream that keeps a chunk index up to date.

A file source reads events; each micro-batch is cut into chunks and makes the index's next
state in one step, which also records the batch. A batch that the stream repeats after a
failure is found there and left out, so every event takes effect once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sextant.functions.scratch import durable
from sextant.operators import index
from sextant.operators.chunking import pieces

UPLOAD, DELETE = "upload", "delete"
EVENTS = "seq long, kind string, doc_id string, text string"


def read_events(spark: SparkSession, folder: str, files: int = 16) -> DataFrame:
    """The stream of the JSON files in ``folder``, at most ``files`` of them in a batch, in the order of their times."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).json(folder)


def cut(documents: DataFrame) -> DataFrame:
    """Chunks of whole texts (doc_id, text) by the recursive splitter."""
    each = documents.select("doc_id", F.posexplode(pieces(F.col("text"))).alias("position", "piece"))
    return each.select(F.concat_ws("::", "doc_id", F.col("position").cast("string")).alias("chunk_id"), "doc_id", F.col("position").cast("int").alias("position"), F.col("piece.text").alias("text"))


def latest(events: DataFrame) -> DataFrame:
    """Of each document the event with the highest ``seq``; events of other kinds or without a document are left out."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("seq"), "kind"))
    known = events.filter(F.col("kind").isin(UPLOAD, DELETE) & F.col("doc_id").isNotNull())
    return known.withColumn("place", place).filter("place = 1").drop("place")


def apply_events(events: DataFrame, path: str, batch: int, stream: str = "documents", chunks: Callable[[DataFrame], DataFrame] = cut) -> bool:
    """Make the ``events`` of one batch the index's next state; false if it has had this batch of the stream."""
    spark = events.sparkSession
    if index.applied(spark, path).get(stream, -1) >= batch:
        return False
    last = durable(latest(events))
    index.replace_documents(spark, path, chunks(last.filter(F.col("kind") == UPLOAD)), changed=last.select("doc_id"), batch=(stream, batch))
    return True


def follow(events: DataFrame, path: str, checkpoint: str, stream: str = "documents", chunks: Callable[[DataFrame], DataFrame] = cut) -> StreamingQuery:
    """Keep the index at ``path`` up to date with the stream ``events`` until all that is there is applied."""
    act = lambda batch, number: apply_events(batch, path, number, stream, chunks)
    return events.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
