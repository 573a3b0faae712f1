"""Corpus preparation: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Nulls and edge cases of the stages: an empty table stays empty and keeps its columns; rows with null or empty texts,
null ids, ties, repeated rows and extra columns (whatever their names) are treated as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assetloom.llm import decontaminate, linededup, minhash, mixing, quality
from assetloom.llm._common import stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject. Without five labels of either class all stay; repeated rows
    go or stay together; null texts and metadata are values of their own."""
    return quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")), only_kept=True)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the later repeated runs of lines. Null ids come first in the order, rows equal in id and
    text keep the same lines, and a text may become empty."""
    return linededup.drop_repeated_runs(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each near-duplicate class; documents without an id stay. Null and empty texts are
    copies of one another; of rows with one id one stays."""
    return minhash.first_of_classes(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage. Null and empty texts hold none; an empty benchmark removes nothing."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates of the remaining documents that bring the domains to their target shares: a row for each document. Texts
    without a word have no tokens; without labels all domains are alike."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", cut_repeated_lines),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", uncontaminated),
    ("mixing to target weights", mixed),
]

#: Trained classifiers, signatures and tilings have no SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
