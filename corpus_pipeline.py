"""A training corpus in five stages: language, near duplicates, repeated passages, test leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thalweg.llm.decontaminate import drop_contaminated
from thalweg.llm.jaccard_join import keep_one_of_each
from thalweg.llm.language_crf import fit_languages, keep_identified
from thalweg.llm.packing import pack_documents
from thalweg.llm.phrase_dedup import remove_repeats
from thalweg.llm.shared import written

#: Least share of a text's words in its language. Text that switches between a few languages stays.
LEAST_LANGUAGE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the random field identifies; without a letter, or without a language, they go."""
    return keep_identified(docs, fit_languages(docs), LEAST_LANGUAGE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that shingles of five words link at a Jaccard similarity of 0.8 or more, the one of smallest doc_id."""
    return keep_one_of_each(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words in windows of 35 words that are anywhere else too."""
    return remove_repeats(docs)


def test_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item's text is found, edited copies included."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, bin_id): every document's places in the bins."""
    return pack_documents(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("test_leaks", test_leaks),
    ("packing", packing),
]

#: The random field, alignment and best fit are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
