"""The operators as queries over whole tables, with production parameters; SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm import hamming, jaccard, mixing, pii, quality, repair, sentencepieces, sharding, token_counts, toxicity
from ebbtide.llm.common import docs_table, fresh_path
from ebbtide.llm.oracle import ORACLE

#: Production parameters.
SHARDS = 40


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 rows of nearest sign codes for every row whose id is divisible by 100, itself included."""
    codes = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", hamming.sign_code(F.col("embedding")).alias("code"))
    return hamming.top_k(codes, codes.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_pieces(docs_table(spark, sf_dir), vocabulary("piece_bpe_32k.model"), with_ids=False, with_decoded=False)


def op3_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "ids")
    repair.write_ids(docs_table(spark, sf_dir), vocabulary("byte_bpe_50k.json"), path)
    return repair.read_ids(spark, path, with_ids=False)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own that starts empty, so that a run never lives off an earlier one."""
    return token_counts.count_tokens(docs_table(spark, sf_dir), vocabulary("piece_bpe_32k.model"), fresh_path(spark, "count-cache"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(docs_table(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("digest")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without rejected_by, which timings decide where several rules would reject."""
    return quality.judge(docs_table(spark, sf_dir)).drop("rejected_by")


def op7_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_records(docs_table(spark, sf_dir), [1.0] * SHARDS)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(docs_table(spark, sf_dir))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(docs_table(spark, sf_dir), width=4, percent=85)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(docs_table(spark, sf_dir)).drop("key", "nth")


__all__ = ["ORACLE", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hamming_topk": op1_hamming_topk,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_repair_ids": op3_repair_ids,
    "op4_token_counts": op4_token_counts,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op7_rendezvous_sharding": op7_rendezvous_sharding,
    "op8_pii": op8_pii,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_source_mixing": op10_source_mixing,
}
