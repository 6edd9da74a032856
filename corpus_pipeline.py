"""A corpus pipeline of five operators: each stage works on all that the one before it kept.

Counted as part of the training-data subpackage. A stage takes (spark, docs, sf_dir) and returns a
frame; every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley.llm import language_id, near_copies, packing, substring_dedup, toxicity
from parley.llm.common import Workspace, read

#: SQL cannot express the learned stages; tests compare the run with a plain version (all pairs, all windows).
ORACLE_SQL = None


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or between whose languages nothing decides, go; where no row names a language, all stay."""
    return language_id.keep_identified(docs, language_id.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies stays: the one with the smallest id, without an id only if none has one.

    Near copies share five-word shingles at a Jaccard similarity of 0.8 or more: fingerprints sort out candidates, the
    shingle sets decide. Rows are judged by their own texts, so rows that share an id or have none don't speak for each other.
    """
    return near_copies.keep_one(docs)


def passage_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; a text that loses words becomes its kept words, others stay as they are.

    ``n_chars`` follows the new text. A document that loses all its words goes.
    """
    return substring_dedup.strip_repeats(docs, size_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 1024 ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("language_id", language_filter),
    ("simhash", near_duplicates),
    ("substring_dedup", passage_removal),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again before the next."""
    work = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = work.put(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            work.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
