"""One query per operator, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm import embeddings, fingerprints, lexical, lm_score, mixing, packing, quality, repair, sharding, simhash, token_counts, topk, warc
from trialframe.llm.oracles import ORACLES  # noqa: F401
from trialframe.scratch import fresh_path, materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.sharded(_table(spark, sf_dir, "documents"), fresh_path(spark, "shards"))
    return rows.select("doc_id", "lang", "source", "n_chars", F.xxhash64("text").alias("text_digest"), "shard", "shard_bytes", "version")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"))
    held_out = (quality.remainder("doc_id", 5) == 0).alias("held_out")
    return quality.with_quality(docs, model).select("doc_id", held_out, "score", "predicted")


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), vocabulary_path())


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sizes = materialize(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")), "sizes")
    mixed = mixing.mix(sizes, "size", tie_col="tie")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(_table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.version_fingerprints(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_dedup(_table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.select(F.col("id").alias("doc_id"), digits, F.col("component").alias("component_id"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired_conversations(_table(spark, sf_dir, "conversations"))


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_packing,
        op3_quality,
        op4_embeddings,
        op5_token_counts,
        op6_mixing,
        op7_lm_scores,
        op8_fingerprints,
        op9_simhash,
        op10_warc,
        op11_repair,
        op12_top_k,
        op13_lexical,
    )
}
