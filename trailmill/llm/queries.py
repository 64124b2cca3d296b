"""The contract queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, langid, lm, mixing, neardup, packing, passages, quality, sharding, tokens
from .common import crc_mod, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    found = langid.fit_identify(docs, learn=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``. Only ids and digests travel; the shuffle doesn't look at texts, so equal texts go anywhere."""
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("bigint").alias("size")
    docs = table(spark, sf_dir, "documents").select("doc_id", size, F.crc32(text.cast("binary")).alias("text_crc32"))
    dealt = sharding.shuffle_to_shards(docs, n_shards=16)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, is_query=F.col("vec_id") % 20 == 0, k=20)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, limit=1024).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = quality.judge(docs).drop("text", "lang")
    return judged.withColumns({c: F.round(c, 9) for c in ("char_distance", "word_distance")})


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    plan = mixing.mixing_plan(docs, weights=(5, 2, 1), most=3)
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, capacity=4096, end=1, with_ids=False)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to six decimals, within which sums in any order agree."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm.score_texts(docs, train=crc_mod(F.col("doc_id"), 7) != 2, order=3)
    held_out = (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out")
    scores = [F.round(c, 6).alias(c) for c in ("base_score", "score")]
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", *scores)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return passages.repeated_passages(docs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
