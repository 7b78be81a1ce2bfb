"""The corpus pipeline: quality, exact dedup, near dedup, mixing, tokens.

Every stage takes the documents that the one before it kept and returns documents
with the same columns; the last returns their tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import byte_bpe, exact_dedup, keep, mixing, near_dedup, quality_fm
from corpusloom.llm.queries import bpe_parameters
from corpusloom.llm.stages import Stages


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a factorisation machine scores 0.5 or more; it learns from the labels of documents not held out."""
    model = quality_fm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_fm.good_documents(docs, model)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    stages = Stages(spark, "pipeline-exact")
    found = exact_dedup.exact_dedup(docs, stages).select(F.xxhash64("doc_id", "text_sha256").alias("key"), "kept")
    key = F.xxhash64("doc_id", F.sha2(exact_dedup.normalised(F.col("text")), 256))
    return keep.keep_rows(docs, key, found, stages, [F.length("text").desc_nulls_last()])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    stages = Stages(spark, "pipeline-near")
    key = F.struct(F.col("doc_id"), F.xxhash64("text").alias("text_hash"))
    found = near_dedup.near_duplicates(docs.select(key.alias("row"), "text"), stages, id_col="row").select(F.xxhash64("row").alias("key"), "kept")
    return keep.keep_rows(docs, F.xxhash64(key), found, stages, [F.col("doc_id")])


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share of the mix asks for."""
    return mixing.mixed_documents(docs, Stages(spark, "pipeline-mix"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    tables, pattern = bpe_parameters()
    # a digest goes along instead of the text
    d = docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    d = byte_bpe.encode(d, Stages(spark, "pipeline-tokens"), tables, pattern, keep_text=False, decoded=True)
    ids = F.when(F.col("ids") == "", F.array().cast("array<int>")).otherwise(F.split("ids", ",").cast("array<int>"))
    return d.select("doc_id", "lang", "source", byte_bpe.n_tokens(F.col("ids")).alias("n_tokens"), ids.alias("ids"), (F.sha2("decoded", 256) == F.col("digest")).alias("round_trip"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("mix_sources", mix_stage),
    ("byte_bpe", tokens_stage),
]

#: A trained model, seeded hashes and rank merges are beyond SQL: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage returns is written before the next one reads it."""
    stages = Stages(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stages.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
