"""A training corpus from raw documents, in five stages.

Each stage reads what the one before it kept and returns documents of the same columns; the last
one returns the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from offsetlake.llm import langid, mixing, near_dup, packing, quality
from offsetlake.llm.common import Work, remainder, table, word_count

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language, which becomes their ``lang``; labels are learnt from and decide nothing else.

    The model learns from the labelled documents of the table but those that op10 holds out. The stages after this one
    take the language from here.
    """
    labelled = table(spark, sf_dir, "documents").filter(remainder("doc_id", 4) != 2)
    return langid.known_documents(docs, langid.fit(labelled), lang="lang")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the thresholds of their language and source."""
    return quality.good_documents(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dup.distinct_documents(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of the permitted lengths."""
    return packing.pack(docs.select("doc_id", word_count("text").alias("n_words")), "n_words")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

# Trained models, sketched signatures and packing have no SQL twin; tests compare the stages with
# brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    work = Work(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = work.keep(docs, name)
    return docs
