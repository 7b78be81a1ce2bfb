"""The registered queries opN_<name> and pipeline: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontamination, embedding_dedup, exact_dedup, line_dedup, mixing, near_dedup, prefix_trie, quality_fm, secrets_cnn, sharding, spelling, url_filter
from .stages import Stages

URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

#: The vocabulary of op6 and of the pipeline, a file of the installed tokenizers.
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), Stages(spark, "op1"))
    return out.drop("uid")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets_cnn.find_secrets(docs, secrets_cnn.train(docs))


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_fm.train(docs, table(spark, sf_dir, "labels"))
    out = quality_fm.score(docs, model)
    return out.select(F.col("id").alias("doc_id"), quality_fm.held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), Stages(spark, "op4"))
    return out.drop("uid")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), Stages(spark, "op5"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


def bpe_parameters(path: str = TOKENIZER) -> tuple[byte_bpe.Tables, str]:
    """Rank tables of a vocabulary file, and the pattern that splits texts into words."""
    import public_tokenizers

    return byte_bpe.Tables(byte_bpe.load_ranks(public_tokenizers.path(path))), public_tokenizers.PATTERN


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, pattern = bpe_parameters()
    out = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), Stages(spark, "op6"), tables, pattern, keep_text=False, decoded=True)
    return out.select("doc_id", byte_bpe.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), Stages(spark, "op7"))
    return out.select("doc_id", "n_lines", "n_kept", "dropped")


def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    d = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("grp"), F.length(text).alias("chars"), (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).alias("lines"))
    dims = {"bytes": sharding.log_bins(F.col("size")), "chars": sharding.log_bins(F.col("chars")), "lines": sharding.log_bins(F.col("lines"))}
    d = sharding.kd_shards(d, Stages(spark, "op8"), dims, F.col("size"), F.col("grp"), n_shards=16)
    d = sharding.with_slots(d, ["grp", "doc_id"])
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), Stages(spark, "op9"))
    return out.drop("uid")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # listed: what campaign links (utm_source) point to, by canonical URL
    u = F.col("url")
    listed = pages.filter(F.regexp_like(u, F.lit(r"[?&]utm_source="))).select(url_filter.canonical(url_filter.host_of(u), url_filter.path_of(u)).alias("canonical"))
    return url_filter.filter_urls(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), Stages(spark, "op11"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), Stages(spark, "op12"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Stages(spark, "op13"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_minhash_near_dedup, op2_secret_scan, op3_quality_fm, op4_exact_dedup, op5_mix_sources, op6_byte_bpe, op7_line_dedup, op8_kd_shards, op9_nn_descent, op10_url_filter, op11_prefix_trie, op12_spelling_variants, op13_decontamination)}
