"""The corpus pipeline: quality, near duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next
stage's docs. All but the last return the columns of documents. Null texts count as empty: the quality stage scores
them like one empty line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgrain.llm import mixing, packing, pii, quality_crf, simhash
from crossgrain.llm.common import materialize, read_table, with_package_path

#: A document is rejected if its score is under this.
LEAST_QUALITY = quality_crf.THRESHOLD


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the line classifier rejects."""
    with_package_path(spark)
    chain = quality_crf.fit(docs, read_table(spark, sf_dir, "labels"))
    return docs.where(quality_crf.score_column(chain) >= LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    with_package_path(spark)
    return simhash.one_of_each(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by placeholders."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that tokens meet the target weights."""
    return mixing.sample(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts' ids into sequences of 2048."""
    with_package_path(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("private", private),
    ("mixture", mixture),
    ("packed", packed),
]
#: No SQL: the stages learn, search and plan; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
