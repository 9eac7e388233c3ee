"""The corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and reread as
the next one's docs.  All but the last return the columns of documents.

Defined results: a null or empty text is scored as a zero vector, and if it is accepted it is one
empty line, no near copy of anything, clean, and one token; repeated rows go through each, a
document and its copies of one id counting as one in line dedup and near copies; a null id is
kept by the stages that compare ids; texts are read whole, whatever their length; ties go to the
smaller id; empty tables give no rows.  Columns of any other name go through as they were, up to
the last stage, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eddyscale.llm import decontamination, jaccard_join, line_dedup, packing, quality
from eddyscale.llm.common import Scratch, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; n_chars follows the text."""
    return line_dedup.without_known_lines(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id."""
    return jaccard_join.near_copies_dropped(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good),
    ("line dedup", new_lines),
    ("n-gram Jaccard join", no_near_copies),
    ("benchmark decontamination", no_benchmark),
    ("best-fit packing", packed),
]

#: A trained classifier decides the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, f"stage-{k}")
            scratch.drop(f"stage-{k - 1}")
    return docs
