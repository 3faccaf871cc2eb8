"""The corpus pipeline: language ID, quality rules, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before it kept.  All stages but the last
return the columns of ``documents``; the last returns a row per packed piece.  ``run`` writes each stage's result as
Parquet in the shared folder and reads it back for the next one.

Each stage bounds the Arrow batches of the session (to 8 MB, where the session has set no limit), as one long-lived executor
serves all of them and what its tasks hold outside the heap adds up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import langid, neardup, packing, quality, substring
from tessera.llm.tokens import vocabulary
from tessera.llm.work import bounded_batches, settle, table

VOCABULARY = "byte_bpe_50k.json"

#: The pipeline's result depends on trained models and on hashed signatures; no SQL gives its rows.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letter, too low a score, or n-grams that the languages hardly know."""
    bounded_batches(spark)
    return langid.in_a_language(docs, langid.train(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rule or that the model, trained on ``labels``, finds bad."""
    bounded_batches(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.good_rows(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, that with the smallest id: five words, a similarity of 0.8 or more."""
    bounded_batches(spark)
    return neardup.one_per_group(docs, 5, (80, 100))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out every word that a repeated window of 35 words covers; all rows stay, and n_chars follows the text."""
    bounded_batches(spark)
    found = substring.remove_repeats(docs, substring.WINDOW)
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    return found.withColumn("n_chars", F.length("text").cast(kind)) if isinstance(kind, T.IntegralType) else found


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 1024 tokens in the proportions of their sources."""
    bounded_batches(spark)
    return packing.digest(packing.pack(docs, vocabulary(VOCABULARY), with_ids=False))


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
