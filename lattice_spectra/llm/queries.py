"""The thin ``opN_*`` queries: each takes ``(spark, sf_dir)`` and returns its whole result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_topk, language_id, packing, pages, permutation_index, pieces, repeats, sharding, toxicity, weighted_minhash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products of every twentieth vector."""
    return exact_topk.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), 0.3)


def op3_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes; equal texts share a shard."""
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def tokenizer_file(name: str) -> str:
    """Path of a vocabulary file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector."""
    return permutation_index.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def op6_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), 2048, 1)


def op7_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 400 bytes go from every document."""
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), 400)


def op8_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text to pieces and back."""
    return pieces.round_trip(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with a weighted Jaccard similarity of 0.8 or more."""
    return weighted_minhash.near_duplicates(_table(spark, sf_dir, "documents"), 0.8)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return pages.extract(_table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_exact_top_k": op1_exact_top_k,
    "op4_language": op4_language,
    "op5_nearest": op5_nearest,
    "op2_toxicity": op2_toxicity,
    "op3_shard_documents": op3_shard_documents,
    "op6_pack_documents": op6_pack_documents,
    "op8_piece_round_trip": op8_piece_round_trip,
    "op9_main_text": op9_main_text,
    "op10_near_duplicates": op10_near_duplicates,
    "op7_remove_repeats": op7_remove_repeats,
}
