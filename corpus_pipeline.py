"""Corpus pipeline: stages over documents, each written as Parquet and reread by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import decontaminate, language_id, line_dedup, ngram_join, packing
from citeloom.llm.common import table, written
from citeloom.llm.native_text import NOT_BLANK


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model rejects (no letters, or far from all centroids) go.

    It learns from the rows with a language that aren't held out. Null and empty texts
    go, as they have no letters; rows that repeat a doc_id are judged one by one, rows
    without an id like all others. An empty table stays one; without labelled rows all
    stay that have a letter.
    """
    return language_id.accepted(docs, language_id.fit(docs.where(~language_id.held_out(F.col("doc_id")))))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first; every document stays, with its new length.

    Copies of a document are left without words here; stage near_duplicates drops them.
    Rows that repeat a doc_id don't take each other's lines; rows without an id neither
    count nor change, and null texts stay null. An empty table stays one.
    """
    found = line_dedup.drop_recurring(docs)
    length = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", length).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links at a Jaccard similarity of 0.8 over five-word shingles stays: the smallest id.

    Documents without words (null and empty texts too) go first. Stage language
    leaves only texts with letters, so these had words, and stage lines found all of
    them in earlier documents. A near copy keeps its own lines, as those are nowhere
    else. Rows that repeat a doc_id stay or go together; rows without an id stay. An
    empty table stays one, and all columns stay as they are.
    """
    return ngram_join.one_of_each(docs.where(F.col("text").rlike(NOT_BLANK)))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths or more of a benchmark item's shingles go.

    Null and empty texts, and rows without an id, stay; rows that repeat a doc_id go
    together. An empty benchmark, or one without words, keeps all documents.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens. A null text is empty and has its end token; every row is a document of its own."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenising and fitted centroids aren't SQL; tests compare each stage with brute force.
ORACLE_SQL = None
