"""From raw documents to packed training sequences, in stages that each read what the one before has kept.

Every stage takes the session, the documents so far and the folder of the tables, and returns documents with the same
columns; the last one returns the packed pieces.  Stages are written to the shared folder in between, so each works
on a table, and lost executors lose no finished stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm import line_dedup, ngram_join, packing, quality, substring_dedup
from basketlens.llm.shared import documents, ship, store


def _recounted(docs: DataFrame) -> DataFrame:
    """With the number of characters of the text as it is now, where the table has one."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the adaptive limits reject go."""
    ship(spark)
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that stood before go, and documents with nothing left."""
    ship(spark)
    return _recounted(line_dedup.remove_repeated_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the smallest id stays."""
    ship(spark)
    return ngram_join.one_of_each(docs)


def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Word sequences that an earlier document has go, and documents with nothing left."""
    ship(spark)
    return _recounted(substring_dedup.remove_repeats(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", dedup_substrings),
    ("best_fit_packing", pack),
]

# Tokenizing and the packing search cannot be said in SQL; tests/llm/test_stages.py compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents in ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = store(docs, name)
    return docs
