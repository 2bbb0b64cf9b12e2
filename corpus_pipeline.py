"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import jaccard, langid, packing, quality, substrings
from lexmill.llm.common import Scratch, documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go; null and empty texts have too few words. Each of several rows with one id or text is judged alone."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null texts, those without a letter, and those like nothing that was learned. Without any language to learn, all stay."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, the one with the smallest id. Documents without words or without an id all stay; of rows with one id, one stays."""
    return jaccard.keep_first(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document with a smaller id holds go; n_chars follows, and all other columns stay. Null texts stay null, rows without an id whole."""
    left = substrings.remove_repeats(docs, replace=True)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in left.columns else left


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens; null and empty texts are one piece of one token. Documents' columns end here."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("best_fit_packing", best_fit_packing),
]

#: DuckDB can't express these stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; between two of them the table is written and read again, and goes when the one after it is there."""
    docs, tables = documents(spark, sf_dir), []
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            tables.append(Scratch(spark))
            docs = tables[-1].table(docs)
            for old in tables[:-1]:
                old.drop()
    return docs
