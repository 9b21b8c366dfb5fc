"""The queries over the driver's tables: one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as dc
from . import embedding_dedup as ed
from . import lexical_search, packing, periodic_runs, segment_sampling, sharding, simhash, suffix_dedup, token_counts, token_store, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_store(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return token_store.digests(spark, store)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_segment_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment_sampling.sample_segmentations(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return found.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    return token_counts.length_histogram(token_counts.token_lengths(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return packing.packed(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.periodic_runs(_table(spark, sf_dir, "documents"), rewrite=periodic_runs.with_planted_period))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": dc.ORACLE_SQL, "op4_embedding_dedup": ed.ORACLE_SQL, "op10_sharding": sharding.ORACLE_SQL, "op12_lexical_search": lexical_search.ORACLE_SQL, "op6_url_filter": url_filter.url_sql()}
