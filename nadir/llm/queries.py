"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ballkmeans, chat, feistel, importance, katz, licenses, linededup, mixing, pieces, quality, simhash, tokenfile, vptree


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "passes")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; the folder may be set by NADIR_TOKENIZERS."""
    import os

    folder = os.environ.get("NADIR_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_katz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_with_holdout(_table(spark, sf_dir, "documents"))


def op4_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and lines taken out of every document, and the crc32 of what stays."""
    out, lines, taken = linededup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col(lines).alias("n_lines"), F.col(taken).alias("n_removed"), F.crc32(F.col("text").cast("binary")).alias("kept_crc32"))


def op6_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), id_lists=False)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.encode_and_read_back(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_vptree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(_table(spark, sf_dir, "embeddings"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one (-7) whose texts are made of control strings."""
    own = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat.format_and_read_back(own.unionByName(extra))


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ballkmeans.cluster(_table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", ballkmeans.centroid_digest().alias("centroid_sha256"))


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The permutation deals rows, so shards' counts are at most one apart."""
    out = feistel.assign(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_vptree_neighbours, op3_katz_score, op4_licence_sentences, op5_line_dedup, op6_sampled_pieces, op7_quality_rules, op8_token_files, op9_simhash_near_dedup, op10_chat_format, op11_ball_kmeans, op12_importance_resample, op13_feistel_shards)}


def oracle_sql() -> dict[str, str]:
    return {"op4_licence_sentences": licenses.scan_sql(), "op11_ball_kmeans": ballkmeans.cluster_sql(), "op13_feistel_shards": feistel.assign_sql()}
