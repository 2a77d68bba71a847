"""The corpus operators as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from sextant.llm import filter_audit as audit
from sextant.llm import vector_codes as codes
from sextant.llm.embedding_dedup import embedding_dedup
from sextant.llm.lm_scoring import lm_scores
from sextant.llm.packing import packing
from sextant.llm.pii import pii_spans
from sextant.llm.quality import quality_filter
from sextant.llm.simhash_dedup import simhash_dedup
from sextant.llm.source_mix import source_mix
from sextant.llm.substring_dedup import substring_dedup
from sextant.llm.token_counts import token_counts
from sextant.llm.toxicity import toxicity
from sextant.llm.vector_topk import vector_topk

QUERIES: dict = {}
ORACLE: dict = {"op12_filter_audit": audit.ORACLE, "op13_vector_codes": codes.oracle(rounds=4)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_embedding_grid_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"), cosine=0.95)


@query
def op2_quality_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_filter(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), quantile=0.98)


@query
def op3_substring_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), window=50, with_text=False).drop("intervals")


@query
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3).select("doc_id", "size", "source_size", "target", "taken")


@query
def op5_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents"))


@query
def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_topk(table(spark, sf_dir, "embeddings"), k=10, every=100, scale=1024)


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing(table(spark, sf_dir, "documents"), tiers=(256, 512, 1024, 2048), with_ids=False)


@query
def op7_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"), shingle=3, budget=3).drop("kept")


@query
def op10_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


@query
def op11_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)
    offsets = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.withColumn("spans", offsets)


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(table(spark, sf_dir, "embeddings"), scale=1024, parts=4, entries=256, rounds=4)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
