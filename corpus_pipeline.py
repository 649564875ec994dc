"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, mixing, token shards.

Each stage is a function of (spark, docs, sf_dir). Its rows are written as Parquet to the shared folder and read again
as the docs of the next one. All but the last return the columns of documents, whatever they are called. Empty tables
give empty results in every stage. Rows are judged one by one where they repeat: rows that share a doc_id or lack one
are told apart by their text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helioframe.llm import decontaminate, mixing, rules, simhash, tokens
from helioframe.llm.common import stage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the likelihood ratio reject go; the trusted target is what `labels` calls good.

    Null and empty texts have fewer than 50 words and go. Without labels the ratio rejects nothing.
    """
    return rules.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id stays, one row of it if it is repeated.

    All documents without a word are one group. Rows without a doc_id come after all others of their group.
    """
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of `benchmark` go; null texts and an empty benchmark contain nothing."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until each source has its share of words. A null source is one source; rows that
    repeat a doc_id are drawn alike, and those without one too."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Binary shards of token ids; one row for each document in them, repeats included. Null texts are empty ones."""
    return tokens.digest(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_to_targets),
    ("token_ids", token_ids),
]

#: The stages hash with XXH64 and encode with a tokenizer, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = table(spark, sf_dir, "documents"), []
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name, done)
        done = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
