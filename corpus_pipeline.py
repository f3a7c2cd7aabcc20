"""The corpus pipeline: five stages over `documents`, each written and read again as the next one's input.

All stages: a null text counts as empty; texts of any length are read whole; an empty table gives an empty result; extra
columns are passed through, whatever their names (the last stage returns its own columns).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factweave.llm import bpe, exact_dedup, mixing, near_dedup, quality
from factweave.llm.common import materialize, table
from factweave.shipping import ship


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier scores at 0.5 or more, each by its own text, also where ids are null or repeat."""
    ship(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts, the one of largest id; rows that repeat both stay together, a null id is the smallest."""
    return exact_dedup.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of least id; texts without words and unmatched null ids stay."""
    ship(spark)
    return near_dedup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, none above three times; texts without words go, a null source is a source."""
    return mixing.take(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row, repeated ones too."""
    ship(spark)
    return bpe.encode_column(docs, *bpe.vocabulary(), digests=True)


STAGES = [("quality", good_quality), ("exact dedup", without_copies), ("near dedup", without_near_copies), ("mixing", mixed), ("encoding", encoded)]
#: A trained classifier and min-max hashing are not SQL; the tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
