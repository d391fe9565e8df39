"""Corpus pipeline: quality, toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. The first four
return the columns of documents; the last returns a row per packed piece.

Rows go or stay whole, but for the texts that lose passages; null texts count as empty. Rows without
text are judged like any other by the classifiers, are one group of near copies (one row stays) and
are packed as their end id. A null doc_id counts like any other id where one of a group stays. Very
long texts are read whole, equal rows are treated alike until one of them stays, other columns pass
through as they are, and no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import op02_quality, op03_toxicity, op07_substring_dedup, op09_simhash, op10_packing
from vellum.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts."""
    return op02_quality.keep_accepted(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples don't call toxic."""
    return op03_toxicity.keep_accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return op09_simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines and sentences that an earlier one has."""
    return op07_substring_dedup.deduplicate(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences."""
    import public_tokenizers

    return op10_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packing)]

#: A fitted classifier and a tokenizer can't be put in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
