"""Corpus pipeline over documents: quality, near duplicates, contamination, mix, token ids.

Every stage works on all rows that its predecessor kept. The first three leave rows out, the fourth repeats or leaves out rows by the mix, the last
returns a row for each document of the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codesieve.llm import decontaminate, mixing, neardup, quality_model, token_output
from codesieve.llm._shared import mark, stash, sweep, unstash


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the classifier rejects (low quality or toxic) go."""
    return quality_model.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each group of near duplicates the document with the smallest id stays, one for each group even where ids are null or repeat."""
    return neardup.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents with an exact phrase of any benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: each document as often as the mix takes it."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: writes the files of token ids; a row for each document in them."""
    return token_output.token_output(docs)


STAGES = [("quality classifier", quality_classifier), ("near-dedup", near_dedup), ("decontamination", decontamination), ("mixing", mix), ("token ids", token_ids)]
#: The mix draws at random and the classifier is fitted, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage wrote besides its result goes as soon as that is written."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        sweep(spark, since, docs)
    result = STAGES[-1][1](spark, docs, sf_dir)  # reads the files that it has written, and no table
    unstash(docs)
    return result
