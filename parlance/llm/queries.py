"""The registered queries: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import alignment, decontamination, embeddings, jaccard, language, licenses, mixing, prefix_trie, recurrent, sharding, suffix_array, token_files, toxicity

SHARD_BYTES = 64 << 10


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_remainder(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.remove_repeats(documents(spark, sf_dir), width=100).drop("spans")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir), 80, 100).select("doc_id", "n_shingles", "component_id", "class_id")


def op3_recurrent_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent.score(documents(spark, sf_dir).withColumn("held_out", id_remainder(7) == 2))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(documents(spark, sf_dir), str(tokenizer_path()), end_id=0)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), weights=(3, 1, 2), share=1.5, max_epochs=2, seed=17)
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir), licenses.TEMPLATES, 0.8)


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), SHARD_BYTES)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.9)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", id_remainder(4) == 2)
    model = language.fit(docs.where("not held_out"))
    return language.identify(docs, model, keep=("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), str(tokenizer_path()), str(tokenizer_path("piece_bpe_32k.model")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("node_id")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", id_remainder(3) == 1)
    scorer = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), id_remainder(3) != 1)
    return toxicity.score(docs, scorer, ("doc_id", "held_out")).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_suffix_dedup, op2_jaccard_join, op3_recurrent_score, op4_token_files, op5_mix_sources, op6_license_scan, op7_shard, op8_embedding_dedup, op9_language_id, op10_decontaminate, op11_token_alignment, op12_prefix_trie, op13_toxicity)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op5_mix_sources": mixing.SQL, "op7_shard": sharding.sql(SHARD_BYTES), "op12_prefix_trie": prefix_trie.SQL}
