"""The corpus pipeline: documents pass stage after stage, each written as Parquet and read again.

Language ID, quality rules, near duplicates, repeated passages and strings, packing. All stages but the last return the columns
of documents; a stage sees all that its predecessor kept, and nothing else.
"""

from __future__ import annotations

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import documents, saved
from tidemark.llm.jaccard import jaccard_components, text_hash
from tidemark.llm.langid import UNKNOWN, identify
from tidemark.llm.packing import pack
from tidemark.llm.quality import judge
from tidemark.llm.substrings import remove_passages, remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts of no known language (by limits for their length) or without a letter; a missing label becomes the predicted one.

    Null and empty texts have no letter and go. Ties go to the language that sorts first; repeated rows share their fate.
    """
    found = identify(docs.select(*COLUMNS), docs, with_foreign=True).where((F.col("lang_pred") != UNKNOWN) & ~F.col("foreign"))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what fails the base rules or diverges from its language's histograms.

    Null and empty texts fail the base rules. A row without lang is held against the nearest reference; repeated rows share their fate.
    """
    return judge(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group, the one with the smallest doc_id (of several texts under it, any one).

    Texts without a word and rows without a doc_id all stay; a row that repeats in all columns but the text's group stays once.
    """
    held = docs.select(*COLUMNS)
    found = jaccard_components(docs, with_group=True)
    first = found.where("group IS NOT NULL AND doc_id IS NOT NULL").groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("one")).select("one.*")
    worded = F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    kept = held.withColumn("text_hash", text_hash("text")).join(first, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return kept.select(*COLUMNS).unionByName(held.where(F.col("doc_id").isNull() | ~F.coalesce(worded, F.lit(False))))


def cut_texts(cut: DataFrame) -> DataFrame:
    """What a removal kept as text, without bytes of characters cut through; null texts stay null."""

    @F.pandas_udf("string")
    def whole_characters(kept: pd.Series) -> pd.Series:
        return kept.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    cut = cut.withColumn("text", F.when(F.col("text").isNotNull(), whole_characters("kept")))
    return cut.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length(F.coalesce("text", F.lit(""))).cast("long"))).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages of 50 words or more that occur more than once, whatever stands between the words; no copy stays.

    Many of them are shorter than the 400 bytes of the next stage. Null texts stay null; repeated rows cut each other.
    """
    return cut_texts(remove_passages(docs.select(*COLUMNS)))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out every byte of strings of 400 bytes that occur more than once, and bytes of characters cut through.

    Null texts stay null, a text that is cut whole becomes empty; repeated rows cut each other.
    """
    return cut_texts(remove_repeats(docs.select(*COLUMNS)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; null and empty texts are the end id alone, repeated rows are packed repeatedly."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("repeated_strings", repeated_strings),
    ("best_fit_packing", best_fit_packing),
]
#: Automata, histograms against learned references and best-fit bins have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
