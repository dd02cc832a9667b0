"""From raw documents to packed token sequences, a stage at a time.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice_spectra.llm import language_id, packing, repeats, toxicity, weighted_minhash
from lattice_spectra.llm.common import materialize
from lattice_spectra.llm.queries import tokenizer_file

#: A document is rejected if no language has at least this mean probability.
LEAST_LANGUAGE = 0.4
TOXIC = 0.3
SIMILAR = 0.8
#: A passage of just over 50 words reaches this at 4 bytes a word; the documents' own rate is about 6. op7_remove_repeats keeps its 400.
REPEATED_BYTES = 200
WINDOW = 2048
#: Words that a worker keeps while packing: fewer than by default, as the stages before have filled the executors' memory.
WORDS = 100_000
#: Columns that operators read; others pass through under other names.
READ = ("doc_id", "text", "lang")


def _renamed(docs: DataFrame) -> DataFrame:
    """``docs`` with names that can't clash for all columns that no operator reads."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in READ else f"_c{i}") for i, c in enumerate(docs.columns)])


def _restored(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[F.col(c if c in READ else f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that look like no learned language."""
    plain = _renamed(docs)
    found = language_id.predict(plain, language_id.learn(plain), tuple(plain.columns))
    return _restored(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)), docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are predicted to be toxic."""
    plain = _renamed(docs)
    model = toxicity.learn(plain, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _restored(toxicity.score(plain, model, tuple(plain.columns)).where(F.col("score") < TOXIC), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return _restored(weighted_minhash.deduplicate(_renamed(docs), SIMILAR), docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings that repeat; a document stays even if nothing of it does."""
    plain = _renamed(docs)
    cut = repeats.remove_repeats(plain, REPEATED_BYTES, tuple(c for c in plain.columns if c != "text"), keep_text=True)
    found = _restored(cut.withColumn("text", F.col("kept_text")), docs)
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), WINDOW, 1, cache=WORDS)


STAGES = [
    ("language", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("repeats", repeated_passages),
    ("packing", packed),
]

#: No stage can be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
