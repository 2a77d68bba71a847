"""Ingest from read pages to chunks, with what a run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.functions.scratch import durable
from sextant.operators.chunking import chunk_documents, run_summary
from sextant.operators.cleaning import classify_sheets, clean_documents, page_lines, trim_annexes

#: What a chunk without a section counts as. Fixed value.
NO_SECTION = "sin sección"


def described(read: DataFrame, catalogue: DataFrame) -> DataFrame:
    """What ``chunk_documents`` wants to know of the documents of ``read_texts``: kind by their text, names from the catalogue by register."""
    pages = read.filter("error is null")
    files = pages.groupBy("doc_id").agg(F.first("path").alias("path"), F.first("format").alias("format"), F.first("register").alias("register"))
    known = catalogue.select(F.col("nregistro").alias("register"), F.col("nombre").alias("name"), F.col("principios_activos").alias("ingredients"), "atc").dropDuplicates(["register"])
    rows = files.join(classify_sheets(pages.select("doc_id", "page", "text")), "doc_id").join(known, "register", "left")
    return rows.select("doc_id", F.col("origin").isNotNull().alias("is_sheet"), (F.col("format") == "md").alias("markdown"), "register", "origin", F.element_at(F.split("path", "/"), -1).alias("file_name"), "name", "ingredients", "atc")


def ingest(read: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of the pages of ``read`` (doc_id, page, text, error), cleaned; ``documents`` as for ``chunk_documents``.

    Sheets of the European register end before their first annex II. Rows with an error give no chunks.
    """
    pages = read.filter("error is null").select("doc_id", "page", "text")
    european = documents.filter("origin = 'ema'").select("doc_id")
    cut = trim_annexes(page_lines(pages.join(european, "doc_id", "left_semi")))
    whole = page_lines(pages.join(european, "doc_id", "left_anti"))
    joined = cut.unionByName(whole).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return chunk_documents(page_lines(durable(clean_documents(joined))), documents)  # read more than once


def ingest_summary(read: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, failures, sheets without sections, sheets with several products, chunks and their sizes."""
    failed = read.agg(F.count(F.when(F.col("error").isNotNull(), 1)).alias("failures"), F.count_distinct(F.when(F.col("error").isNull(), F.col("doc_id"))).alias("documents"))
    each = chunks.groupBy("doc_id").agg(F.max(F.col("kind") == "ficha_tecnica").alias("cut"), F.max(F.col("chunk_id").contains("::p2::")).alias("several"))
    each = each.join(documents.select("doc_id", "is_sheet"), "doc_id")
    sheets = each.agg(F.count(F.when(F.col("is_sheet") & ~F.col("cut"), 1)).alias("unsectioned"), F.count(F.when(F.col("several"), 1)).alias("multi_product"))
    sizes = run_summary(chunks).drop("documents")
    return failed.join(F.broadcast(sheets)).join(F.broadcast(sizes)).select("documents", "failures", "unsectioned", "multi_product", "chunks", "mean_size", "median", "least", "most")


def chunks_per_section(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.coalesce("section", F.lit(NO_SECTION)).alias("section")).agg(F.count("*").alias("chunks"))
